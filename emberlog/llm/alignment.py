"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

Tokenizer A is a byte-level BPE file, B a SentencePiece BPE model that puts a blank before
a text. Both cover the bytes of blank + text; the offsets where tokens of both end cut
them into groups, and every A and B token whose byte ranges overlap are linked.

A text is cut where a blank or line end follows a character that is no white space. There
no token of either kind goes on (B's model is checked for it when it is loaded), so a
text's tokens, groups and links are those of its stretches one after another. Stretches
new to a worker are aligned together: cumulated token lengths give the ends, their
intersection the cuts, a sorted search the group labels and each token's first and last
partner, and repeating by their number writes the links out. Known stretches come from a
bounded cache.

A row's distinct pairs and their numbers are kept packed. Pair totals are summed within
tasks, then by (pair, salt), then by pair. The pairs that are counted most, ``FREQUENT`` of
them at most, are broadcast; the others of each row meet their totals in a join, so every
link is counted whatever its pair.

Null and empty texts, and texts whose tokens of either kind do not spell blank + text (as
where a text holds U+2581), have no tokens: zeros and an empty digest. Rows are taken one
by one: equal ones, equal ids and null ids give a row each, and all their links count. Long
texts are aligned whole. Extra columns are ignored, and no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, store, text

#: The pattern by which byte-level vocabularies cut text (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"
#: Stretches of each generation that a worker keeps, and pairs that it sums before it sends them.
CACHE, HELD = 200_000, 1 << 20
#: Stretches that B's model reads at once.
TOGETHER = 24
#: Pairs that are broadcast, 17 bytes each, and salts of the sums.
FREQUENT, SALTS = 1 << 18, 16
_PACK = pa.Codec("zstd", 1)


class ByteTokens:
    """Ids and bytes of a byte-level BPE file; special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab, merges = given["model"]["vocab"], given["model"]["merges"]
        byte = {c: b for b, c in enumerate(bpe.byte_letters())}
        special = {t["id"] for t in given["added_tokens"]}
        ranks = {bytes(byte[c] for c in name): i for name, i in vocab.items() if i not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError("ids of the vocabulary do not follow its merges")
        self.size = max(vocab.values()) + 1
        self.length = np.zeros(self.size, np.int64)
        for x, i in ranks.items():
            self.length[i] = len(x)
        self.encode = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceTokens:
    """Ids and bytes of a SentencePiece model, for stretches that begin with a blank or line end."""

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        if any(re.search(f"[^{MARK}]{MARK}|\n", x) for x in names):
            raise ValueError("a piece holds a marker after another character, or a line end")
        self.bytes = [bytes([int(x[1:-1], 16)]) if sp.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.mark = sp.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The model puts the marker before a text; the text's own blank stands for it."""
        found = self.inner.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        return [(ids or [self.mark]) if x[0] == " " else ids[1:] for x, ids in zip(texts, found, strict=True)]

    def spelt(self, x: str, ids: list[int]) -> bool:
        return MARK not in x and b"".join(map(self.bytes.__getitem__, ids)) == x.encode()


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of blank + text, begins, ends, first stretch of each text); empty texts have none.

    A stretch begins at a blank or line end after what is surely no white space of any kind.
    """
    full = np.diff(off) > 0
    data = np.insert(data, off[:-1][full], np.uint8(32))
    off = np.concatenate([[0], np.cumsum(np.diff(off) + full)])
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(off), np.int64)
    before, second, third = (np.concatenate([np.full(k, 32, np.uint8), data[:-k]])[: len(data)] for k in (1, 2, 3))
    # U+0085 and U+00A0, U+1680 and U+2000 to U+307F end in these bytes
    white = (before <= 32) | (second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3) & (before >= 0x80))
    begins = np.flatnonzero(((data == 32) | (data == 10)) & ~white)
    begins = np.union1d(begins, off[:-1][full])
    return data, begins, np.append(begins[1:], len(data)), np.searchsorted(begins, off)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_type, self.b_type = (np.uint16 if x.size <= 1 << 16 else np.uint32 for x in (self.a, self.b))
        n, m = self.a.size, self.b.size
        # an id with what follows it: the next of its side, the other side, or the next group
        self.written = [f"{i}{end}".encode() for side, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(side)]
        self.young: dict[int, tuple[bytes, bytes, bytes]] = {}
        self.old: dict[int, tuple[bytes, bytes, bytes]] = {}

    def look_up(self, keys: list[int], stretch) -> list[tuple[bytes, bytes, bytes]]:
        """Of each stretch its groups, the keys of its links, and (A tokens, B tokens, groups).

        A stretch in use is kept: there are two generations of ``CACHE`` stretches.
        """
        found = list(map(self.young.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        if len(self.young) + len(gaps) > CACHE:
            self.old, self.young = self.young, {}
        fresh = []
        for i in gaps:
            if (x := self.old.get(keys[i])) is None:
                fresh.append(i)
            else:
                found[i] = self.young[keys[i]] = x
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            for i, x in zip(some, self.learn([stretch(i) for i in some]), strict=True):
                found[i] = self.young[keys[i]] = x
        return found

    def learn(self, new: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Stretches that end in white space stand alone; others are read together."""
        out: list[tuple[bytes, bytes, bytes]] = [(b"", b"", b"")] * len(new)
        order = sorted(range(len(new)), key=lambda i: new[i][-1].isspace() or new[i][-1] < "!")
        plain = next((k for k, i in enumerate(order) if new[i][-1].isspace() or new[i][-1] < "!"), len(order))
        groups = [order[k : min(k + TOGETHER, plain)] for k in range(0, plain, TOGETHER)] + [[i] for i in order[plain:]]
        texts = ["".join([new[i] for i in g]) for g in groups]
        b, good = self.b.encode(texts), []
        for g, x, ids in zip(groups, texts, b, strict=True):
            if self.b.spelt(x, ids):
                good.append((g, x, ids))
            elif len(g) > 1:
                alone = self.b.encode([new[i] for i in g])
                good += [([i], new[i], ids) for i, ids in zip(g, alone, strict=True) if self.b.spelt(new[i], ids)]
        if good:
            which = [i for g, _, _ in good for i in g]
            found = self.aligned([self.a.encode(x) for _, x, _ in good], [ids for _, _, ids in good], np.array([len(new[i].encode()) for i in which]))
            for i, x in zip(which, found, strict=True):
                out[i] = x
        return out

    def aligned(self, a: list[list[int]], b: list[list[int]], sizes: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """Stretches of so many bytes one after another, on one line of bytes."""
        a_id, b_id = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_end, b_end = np.cumsum(self.a.length[a_id]), np.cumsum(self.b.length[b_id])
        ends = np.cumsum(sizes)
        a_to, b_to = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        # partners of each A token: from the first B token that ends after its begin to the last that begins before its end
        first = np.searchsorted(b_end, a_end - self.a.length[a_id], "right")
        many = np.searchsorted(b_end - self.b.length[b_id], a_end, "left") - first
        links = np.cumsum(many)
        keys = np.repeat(a_id, many) * self.b.size + b_id[np.repeat(first - links + many, many) + np.arange(len(links) and links[-1])]
        # groups as text: each group's A tokens, then its B tokens
        a_in, b_in = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        begin = np.cumsum(a_in + b_in) - a_in - b_in
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        code = np.empty(len(a_id) + len(b_id), np.int64)
        code[begin[a_group] + np.arange(len(a_id)) - (np.cumsum(a_in) - a_in)[a_group]] = a_id + a_last * self.a.size
        code[(begin + a_in)[b_group] + np.arange(len(b_id)) - (np.cumsum(b_in) - b_in)[b_group]] = b_id + (2 * self.a.size + b_last * self.b.size)
        tokens = list(map(self.written.__getitem__, code.tolist()))
        to, groups = (a_to + b_to).tolist(), a_group[a_to - 1] + 1  # a stretch ends with a group
        stats = np.diff(np.stack([a_to, b_to, groups], 1), axis=0, prepend=0).astype(np.int32).tobytes()
        raw, link_to = keys.tobytes(), (8 * links[a_to - 1]).tolist()
        return [(b"".join(tokens[s:e])[:-1], raw[k:m], stats[12 * i : 12 * i + 12]) for i, (s, e, k, m) in enumerate(zip([0, *to], to, [0, *link_to], link_to))]

    def rows(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, str, bytes | None]]:
        """Of each text (A tokens, B tokens, groups, links, digest of the groups, packed pairs)."""
        data, begins, ends, first = stretches(data, off)
        hashes, at, which = np.unique(text.span_hashes(data, begins, ends), return_index=True, return_inverse=True)
        raw, s, e = data.tobytes(), begins[at].tolist(), ends[at].tolist()
        found = self.look_up(hashes.tolist(), lambda i: raw[s[i] : e[i]].decode("utf-8", "replace"))
        groups, keys = [x[0] for x in found], [x[1] for x in found]
        bad = np.array([not x for x in groups], bool)[which] if len(which) else np.zeros(0, bool)
        bad_before = np.concatenate([[0], np.cumsum(bad)])
        stats = np.zeros((len(which) + 1, 3), np.int64)
        if len(which):
            np.cumsum(np.frombuffer(b"".join([x[2] or bytes(12) for x in found]), np.int32).reshape(-1, 3)[which], axis=0, out=stats[1:])
        which = which.tolist()
        out: list[tuple[int, int, int, int, str, bytes | None]] = []
        for f, t in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if f == t or bad_before[t] > bad_before[f]:
                out.append((0, 0, 0, 0, "", None))
                continue
            links = np.frombuffer(b"".join(map(keys.__getitem__, which[f:t])), np.int64)
            digest = hashlib.sha256(b";".join(map(groups.__getitem__, which[f:t]))).hexdigest()
            out.append((*(stats[t] - stats[f]).tolist(), len(links), digest, self.packed(links)))
        return out

    def packed(self, keys: np.ndarray) -> bytes:
        """Distinct pairs in order, as steps of A ids, B ids and numbers above one."""
        pairs, many = np.unique(keys, return_counts=True)
        a, b = np.divmod(pairs, self.b.size)
        raw = np.diff(a, prepend=0).astype(self.a_type).tobytes() + b.astype(self.b_type).tobytes() + (many - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
        return len(pairs).to_bytes(4, "little") + _PACK.compress(raw, asbytes=True)

    def unpacked(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int.from_bytes(packed[:4], "little")
        sizes = np.cumsum([n * np.dtype(self.a_type).itemsize, n * np.dtype(self.b_type).itemsize, 4 * n]).tolist()
        raw = _PACK.decompress(packed[4:], decompressed_size=sizes[2], asbytes=True)
        a = np.cumsum(np.frombuffer(raw[: sizes[0]], self.a_type).astype(np.int64))
        many = np.ascontiguousarray(np.frombuffer(raw[sizes[1] :], np.uint8).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64) + 1
        return a * self.b.size + np.frombuffer(raw[sizes[0] : sizes[1]], self.b_type), many


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def summed(keys: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(k) else n


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: counts, the digest of its groups, and its pairs packed."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary())])

    def run(it):
        found = aligner(a_path, b_path)
        for part, data, off in text.slices(it, text.WORD_SLICE_BYTES):
            yield text.table(schema, part.column("row"), part.column("doc_id"), *map(list, zip(*found.rows(data, off), strict=True)))

    rows = store.documents(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


def totals(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key (A id * B ids + B id), n (links of the pair), best (none of its B id's pairs has more)."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(it):
        found = aligner(a_path, b_path)
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        many: list[np.ndarray] = [np.zeros(0, np.int64)]
        held = 0

        def sent():
            for at in range(0, len(keys[0]), 1 << 16):
                yield text.table(schema, keys[0][at : at + (1 << 16)], many[0][at : at + (1 << 16)])

        for b in it:
            for x in b.column("pairs").drop_null().to_pylist():
                k, n = found.unpacked(x)
                keys.append(k)
                many.append(n)
                held += len(k)
                if held >= HELD:
                    k, n = summed(keys, many)
                    keys, many, held = [k], [n], 0
                    if len(k) >= HELD:
                        yield from sent()
                        keys, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k, n = summed(keys, many)
        keys, many = [k], [n]
        yield from sent()

    b_size = aligner(a_path, b_path).b.size
    parts = rows.select("pairs").mapInArrow(run, "key long, n long").withColumn("salt", F.spark_partition_id() % SALTS)
    sums = parts.groupBy("key", "salt").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n")).withColumn("b", F.col("key") % b_size)
    sums, path = store.save(sums)
    most = F.broadcast(sums.groupBy("b").agg(F.max("n").alias("most")))  # a row for each B id at most
    out, _ = store.save(sums.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")))
    store.drop(sums.sparkSession, path)
    return out


def frequent(pairs: DataFrame, most: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count that at most ``most`` pairs reach, and those pairs in order of their keys."""
    steps = pairs.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # some hundred rows
    least, seen = 1 << 62, 0
    for r in steps:
        seen += r.pairs
        if seen > most:
            break
        least = r.least
    t = pairs.where(F.col("n") >= least).toArrow().sort_by("key")
    return least, *(t.column(c).to_numpy() for c in ("key", "n", "best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]
    rows, rows_path = store.save(aligned(docs, a_path, b_path))
    pairs = totals(rows, a_path, b_path)
    least, *known = frequent(pairs)
    sent = spark.sparkContext.broadcast(known)  # FREQUENT pairs at most
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("keys", pa.list_(pa.int64())), ("many", pa.list_(pa.int64()))])

    def look_up(it):
        found = aligner(a_path, b_path)
        keys, counts, best = sent.value
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sums, rest = [], []
                for x in part.column("pairs").to_pylist():
                    k, n = found.unpacked(x) if x is not None else (np.zeros(0, np.int64),) * 2
                    place = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
                    hit = keys[place] == k if len(keys) else np.zeros(len(k), bool)
                    place, here = place[hit], n[hit]
                    sums.append((int(here[best[place]].sum()), int((here * counts[place]).sum())))
                    rest.append((k[~hit], n[~hit]))
                yield text.table(schema, *(part.column(c) for c in kept), *map(list, zip(*sums, strict=True)), [x for x, _ in rest], [x for _, x in rest])

    looked, _ = store.save(rows.mapInArrow(look_up, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + ", n_best long, count_sum long, keys array<long>, many array<long>"))
    store.drop(spark, rows_path)
    rest = looked.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "many")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.many").alias("many"))
    rest = rest.join(pairs.where(F.col("n") < least), "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("b"), F.sum(F.col("many") * F.col("n")).alias("c"))
    out = looked.drop("keys", "many").join(rest, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"), "groups_sha256")
