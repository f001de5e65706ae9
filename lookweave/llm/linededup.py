"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Tokens are ordered by rarity, counted over all documents; lines of J >= percent / 100
share one of their first n - ceil(J n) + 1 tokens.  Lines with equal sets become one class first.  Postings of these
prefixes meet per token, and length, position and a parity sketch of the set (which bounds the difference from below) leave
few pairs, whose Jaccard is then computed on the full sets.  A line that matches an earlier one is removed.

Postings travel by the bucket of their token's hash, those of some thousand lines as one row of byte planes.

Long posting lists are split into cells of a grid, so a token may be as frequent as it likes.  A line meets at most
``FIRST`` earlier lines per token at first; lines that stay unmatched and had more go through the rest in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import FILTER_BITS, bit_filter, fresh, line_counts, line_words, passing, slices, word_counts

COUNT_BITS, BLOCK_BITS = 24, 14  # counters of the rarity order, counters to a block
LEVEL = 48  # a token's key is its level of rarity above a hash of this many bits
LIST = 4096  # postings of a token that are compared in one place
FIRST = 2
BUCKET, HELD = 1 << 16, 1 << 18  # postings of a bucket, about; postings of a task that travel together
DOCS = 128  # documents whose words are arrays at a time
LONG = 64  # lines of more tokens have a sketch of 128 bits
PLACE = f"pmod(pmod(doc, {(1 << FILTER_BITS) - 3}) * 40503 + line * 7919L, {1 << FILTER_BITS})"
LARGEST = (1 << 63) - 1


def _levels(documents: DataFrame) -> np.ndarray:
    """Rarity level (eighths of a doubling) per hashed token: a table of fixed size, counted over all documents.

    Tokens that share a counter look more frequent than they are, which costs time but no match.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int32)
        for batch in slices(batches, DOCS):
            h, _ = line_words(batch.column(0).cast(pa.binary()).to_pylist())
            slots, counts = np.unique((h & np.uint64((1 << COUNT_BITS) - 1)).astype(np.uint32), return_counts=True)
            total[slots] += counts.astype(np.int32)
        blocks = total.reshape(-1, 1 << BLOCK_BITS)
        for at in np.flatnonzero(blocks.any(axis=1)):
            where = np.flatnonzero(blocks[at])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([where.astype(np.uint16).tobytes()]), pa.array([blocks[at][where].tobytes()])], names=["block", "places", "counts"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for places, counts in zip(part["places"], part["counts"]):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
        return pd.DataFrame({"block": part["block"].iloc[:1], "levels": [np.minimum(255, 8 * np.log2(np.maximum(1, total))).astype(np.uint8).tobytes()]})

    counted = documents.select("text").mapInArrow(count, "block int, places binary, counts binary")
    out = np.zeros((1 << COUNT_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for r in counted.groupBy("block").applyInPandas(merge, "block int, levels binary").collect():  # 16 MB in all
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _line_sets(h: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all lines' distinct tokens, each line's from the rarest on, and their number per line."""
    flat, sizes, ends = [], np.zeros(len(counts), np.int64), np.r_[0, np.cumsum(counts)]
    keys = levels[h & np.uint64((1 << COUNT_BITS) - 1)].astype(np.uint64) << np.uint64(LEVEL) | h >> np.uint64(64 - LEVEL)
    for at in range(0, len(counts), 255):
        some = counts[at:at + 255]
        # the line above the key, so that one sort of numbers orders everything
        owner = np.repeat(np.arange(len(some), dtype=np.uint64), some)
        ordered = np.sort(owner << np.uint64(LEVEL + 8) | keys[ends[at]:ends[at + len(some)]])
        ordered = ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered
        sizes[at:at + len(some)] = np.bincount((ordered >> np.uint64(LEVEL + 8)).astype(np.int64), minlength=len(some))
        flat.append((ordered & np.uint64((1 << LEVEL + 8) - 1)).view(np.int64))
    return np.concatenate(flat) if flat else np.empty(0, np.int64), sizes


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of the prefix; sets so small that only equal ones can match need none."""
    return np.where(100 * n < percent * (n + 1), 0, n + (-percent * n // 100) + 1)


def _line_table(documents: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """doc, line, n (distinct tokens), mark (of the set), keys (the prefix's tokens that occur elsewhere, its last ones), b0 and b1 (the sketch) of every line with a word.

    Bit k of the sketch is the parity of the tokens with that place, so sets that differ in d tokens have sketches that
    differ in d bits at most.  b0 has 64 places; b1 holds the odd half of 128 places for lines of over ``LONG`` tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, DOCS):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            flat, n = _line_sets(*line_words(texts), levels)
            own = line_counts(texts)
            docs = np.repeat(batch.column(0).to_numpy(), own)
            at = np.arange(len(docs)) - np.repeat(np.cumsum(own) - own, own)
            worded = np.flatnonzero(n)
            docs, at, n = docs[worded], at[worded].astype(np.int32), n[worded]
            if not len(n):
                continue
            ends = np.cumsum(n)
            starts = ends - n
            bit = np.uint64(1) << (flat & 63).astype(np.uint64)
            b0 = np.bitwise_xor.reduceat(bit, starts).view(np.int64)
            b1 = np.where(n > LONG, np.bitwise_xor.reduceat(np.where(flat & 64, bit, np.uint64(0)), starts).view(np.int64), 0)
            marks = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            prefix = _prefix(n, percent)
            first = np.arange(prefix.sum()) + np.repeat(starts - (np.cumsum(prefix) - prefix), prefix)
            owner = np.repeat(np.arange(len(n)), prefix)
            shared = flat[first] >> LEVEL > 0  # a token that is counted once has no partner; such tokens come first
            cuts = 8 * np.searchsorted(owner[shared], np.arange(len(n) + 1)).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat[first[shared]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(at), pa.array(n.astype(np.int32)), pa.array(marks, pa.binary()), keys, pa.array(b0), pa.array(b1)], names=["doc", "line", "n", "mark", "keys", "b0", "b1"])

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("doc")
    return documents.select(own, "text").mapInArrow(run, "doc long, line int, n int, mark binary, keys binary, b0 long, b1 long")


def _frequent() -> int:
    """Only tokens with keys from here on can have more than ``LIST`` postings."""
    return int(8 * np.log2(LIST)) << LEVEL


def _cells(postings: DataFrame) -> DataFrame:
    """Adds cell and side: lists of over ``LIST`` postings are cut into parts, and every two parts meet in a cell.

    ``side`` is 0 in a cell of one part, else 1 or 2 for the part.
    """
    frequent = F.col("key") >= F.lit(_frequent())
    rare = postings.where(~frequent).select("*", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"))
    many = postings.where(frequent)
    parts = many.groupBy("key").agg(F.ceil(F.count("*") / LIST).alias("parts"))
    many = many.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc", "line"), F.col("parts")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return rare.unionByName(many.withColumns({"cell": cell, "side": side}).drop("parts", "part", "other"))


_PAIRS = pa.schema([(f"{c}_{s}", t) for s in "xy" for c, t in (("doc", pa.int64()), ("line", pa.int32()))] + [("key", pa.int64())])
_FOUND = "doc_x long, line_x int, doc_y long, line_y int, key long"
_POSTING = {"key": np.int64, "doc": np.int64, "line": np.int32, "n": np.int32, "i": np.int32, "b0": np.int64, "b1": np.int64}


def _expanded(batch: pa.RecordBatch, percent: int) -> dict[str, np.ndarray]:
    """The postings of heads (doc, line, n, keys, b0, b1); i is a token's place in its line."""
    held = batch.column("keys").to_pylist()
    counts = np.array([len(k) >> 3 for k in held], np.int64)
    owner = np.repeat(np.arange(len(held)), counts)
    rows = {c: batch.column(c).to_numpy()[owner] for c in ("doc", "line", "n", "b0", "b1")}
    after = (np.cumsum(counts))[owner] - np.arange(len(owner))
    return rows | {"key": np.frombuffer(b"".join(held), np.int64), "i": (_prefix(rows["n"].astype(np.int64), percent) - after).astype(np.int32)}


def _by_place(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The order of postings by key, doc and line."""
    key, doc, line = rows["key"], rows["doc"], rows["line"]
    held, least = np.unique(key, return_inverse=True)[1], int(doc.min())
    docs, lines = int(doc.max()) - least + 1, int(line.max()) + 1
    if len(key) * docs * lines < 1 << 63:  # one sort of numbers, where they fit
        return np.argsort((held * docs + (doc - least)) * lines + line)
    return np.lexsort((line, doc, key))


def _meet(rows: dict[str, np.ndarray], percent: int, most: int | None) -> pa.RecordBatch | None:
    """Pairs of a line (x) and an earlier one (y) that pass the filters, of rows by key, cell, doc and line.

    (x, null, key) says that x has more than ``most`` on a key; ``asked`` which lines look for earlier ones.
    """
    key, cell, side, asked, doc, line, i = (rows.get(c) for c in ("key", "cell", "side", "asked", "doc", "line", "i"))
    n = rows["n"].astype(np.int64)
    high = (100 + percent) * (n - i) // percent - n  # the largest set that can share enough from this place on
    small, low = n.astype(np.int32), high.clip(max=LARGEST >> 32).astype(np.int32)  # half the memory for what all pairs read
    start = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1] if cell is not None else False)]
    first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    rank, found = np.arange(len(key)) - first, np.zeros(len(key), np.int64)
    b0, b1 = rows["b0"].view(np.uint64), rows["b1"].view(np.uint64)
    live = np.flatnonzero((rank > 0) & (True if asked is None else asked))
    live = live[np.argsort(-rank[live], kind="stable")]  # those that still have rows to meet come first
    ranks, firsts, ns, highs = -rank[live], first[live], small[live], low[live]
    xs, ys, more = [], [], []
    for step in range(int(rank.max(initial=0))):
        open_ = int(np.searchsorted(ranks, -step))
        if not open_:
            break
        y = firsts[:open_] + step  # the earliest rows come first
        ok = np.flatnonzero(small.take(y) <= highs[:open_])
        y = y.take(ok)
        also = np.flatnonzero(ns.take(ok) <= low.take(y))
        if not len(also):
            continue
        x, y = live[ok[also]], y[also]
        both = n[x] + n[y]
        most_apart = both - 2 * -(-percent * both // (100 + percent))
        c0 = b0[x] ^ b0[y]
        ok = np.bitwise_count(c0) <= most_apart  # of the 64 places, and for long lines of the 128 ones
        x, y, c0, most_apart = x[ok], y[ok], c0[ok], most_apart[ok]
        c1 = b1[x] ^ b1[y]
        ok = (np.bitwise_count(c1).astype(np.int64) + np.bitwise_count(c0 ^ c1) <= most_apart) | (np.minimum(n[x], n[y]) <= LONG)
        ok &= (doc[x] != doc[y]) | (line[x] != line[y])
        if side is not None:
            ok &= (side[x] == 0) | (side[x] != side[y])  # rows of one part meet in that part's own cell
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        found[x] += 1
        over = found[x] > most if most else np.zeros(len(x), bool)
        xs.append(x[~over])
        ys.append(y[~over])
        if over.any():
            more.append(x[over])
            stay = found[live] <= most
            live, ranks, firsts, ns, highs = (a[stay] for a in (live, ranks, firsts, ns, highs))
    if not xs:
        return None
    x, y, over = np.concatenate(xs), np.concatenate(ys), np.concatenate([np.empty(0, np.int64), *more])
    if not len(x) and not len(over):
        return None
    none = [None] * len(over)
    sides = [pa.concat_arrays([pa.array(a, t), pa.array(b, t)]) for a, b, t in ((doc[x], doc[over], pa.int64()), (line[x], line[over], pa.int32()), (doc[y], none, pa.int64()), (line[y], none, pa.int32()), (key[x], key[over], pa.int64()))]
    return pa.RecordBatch.from_arrays(sides, schema=_PAIRS)


def _bucket_candidates(heads: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (as of ``_meet``) on the tokens whose lists are bounded by ``LIST``."""
    spark = heads.sparkSession
    postings = heads.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    frequent = _frequent()
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings) // BUCKET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> pa.RecordBatch:
            rows = {c: np.concatenate([p[c] for p in held]) for c in _POSTING}
            order = np.argsort(rows["key"] & (1 << LEVEL) - 1)
            place = (rows["key"][order] >> LEVEL - 32 & (1 << 32) - 1) * buckets >> 32  # by the hash's first bits, so in order
            cuts = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)]
            rows = {c: v[order] for c, v in rows.items()}
            # byte planes, as most are nearly constant
            packed = [b"".join(v[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for v in rows.values()) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "n", "rows"])

        held, size = [], 0
        for batch in batches:
            rows = _expanded(batch, percent)
            rare = rows["key"] < frequent
            held.append({c: rows[c][rare] for c in _POSTING})
            size += int(rare.sum())
            if size >= HELD:
                yield dealt()
                held, size = [], 0
        if size:
            yield dealt()

    def unpacked(n: int, packed: bytes) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for c, kind in _POSTING.items():
            width = np.dtype(kind).itemsize
            out[c] = np.ascontiguousarray(np.frombuffer(packed, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
            at += n * width
        return out

    def met(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([p[c] for p in held]) for c in _POSTING}
        order = _by_place(rows)
        if (out := _meet({c: v[order] for c, v in rows.items()}, percent, most)) is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                bucket, n, packed = (batch.column(k)[at].as_py() for k in range(3))
                if bucket != last and size >= 2 * BUCKET:  # whole buckets, some at a time
                    yield from met(held)
                    held, size = [], 0
                held.append(unpacked(n, packed))
                size, last = size + n, bucket
        if held:
            yield from met(held)

    dealt_out = heads.mapInArrow(deal, "bucket int, n int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt_out.mapInArrow(run, _FOUND)


def _postings(heads: DataFrame, percent: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Postings as rows: of the frequent tokens, or of those whose place is in a bitmap."""
    frequent = _frequent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _expanded(batch, percent)
            at = np.flatnonzero(rows["key"] >= frequent) if wanted is None else passing(wanted, rows["key"] & (1 << FILTER_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][at]) for c in _POSTING], names=list(_POSTING))

    if wanted is None:  # a line's last key is its most frequent one; its level is the last byte but one
        heads = heads.where(F.expr(f"substring(keys, -2, 1) >= X'{frequent >> LEVEL:02X}'"))
    return heads.mapInArrow(run, "key long, doc long, line int, n int, i int, b0 long, b1 long")


def _candidates(postings: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (as of ``_meet``) on postings with cell, side and asked, which come as rows."""
    names = ["key", "cell", "doc", "line", "n", "i", "side", "asked", "b0", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            if not len(rows["key"]):
                continue
            # the last list may go on in the next batch; a list has a bounded size
            last = np.flatnonzero((rows["key"] != rows["key"][-1]) | (rows["cell"] != rows["cell"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = {c: v[cut:] for c, v in rows.items()}
            if cut and (out := _meet({c: v[:cut] for c, v in rows.items()}, percent, most)) is not None:
                yield out
        if held is not None and len(held["key"]) and (out := _meet(held, percent, most)) is not None:
            yield out

    placed = postings.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell", "doc", "line")
    return placed.mapInArrow(run, _FOUND)


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, line, tokens (hashes) of the wanted (doc, line)."""
    bitmap = bit_filter(wanted.select(F.expr(PLACE).alias("slot")), "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            own = line_counts(texts)
            row = np.repeat(np.arange(len(texts)), own)
            at = np.arange(len(row)) - (np.cumsum(own) - own)[row]
            docs = batch.column(0).to_numpy()[row]
            hit = passing(bitmap, (docs % ((1 << FILTER_BITS) - 3) * 40503 + at * 7919) % (1 << FILTER_BITS))
            docs, at, sets, last, lines = docs[hit], at[hit], [], -1, []
            for k, i in zip(row[hit].tolist(), at.tolist()):
                if k != last:
                    lines, last = lines_of(texts[k]), k
                sets.append(list({xxhash.xxh3_64_intdigest(w) >> 1 for w in lines[i].lower().split()}))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "line", "tokens"])

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("doc")
    return documents.select(own, "text").mapInArrow(run, "doc long, line int, tokens array<long>").join(wanted, ["doc", "line"], "left_semi")


def _verified(documents: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Lines (doc, line) with a confirmed earlier match.

    A line first meets the earlier one with which it shares most keys; only where that fails the others.
    """
    x, y = ["doc_x", "line_x"], ["doc_y", "line_y"]
    pairs = materialize(found.groupBy(*x, *y).agg(F.count("*").alias("keys")))
    wanted = pairs.select(F.explode(F.array(*[F.struct(F.col(f"doc_{s}").alias("doc"), F.col(f"line_{s}").alias("line")) for s in "xy"])).alias("at")).select("at.*").distinct()
    sets = materialize(_sets(documents, materialize(wanted)))

    def confirmed(some: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("doc").alias(f"doc_{s}"), F.col("line").alias(f"line_{s}"), F.col("tokens").alias(s))
        met = some.select(*x, *y).join(side("x"), x).join(side("y"), y)
        shared = F.size(F.array_intersect("x", "y"))
        met = met.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared))
        return materialize(met.select(F.col("doc_x").alias("doc"), F.col("line_x").alias("line")).distinct())

    best = pairs.groupBy(*x).agg(F.max(F.struct("keys", *y)).alias("b")).select(*x, *[F.col(f"b.{c}").alias(c) for c in y])
    near = confirmed(best)
    left = pairs.join(best, [*x, *y], "left_anti").join(near.select(F.col("doc").alias("doc_x"), F.col("line").alias("line_x")), x, "left_anti")
    return near.union(confirmed(left))


def first_lines(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc, line of every line with a word that neither repeats nor nearly repeats an earlier one, ``line`` counting from 0.

    Earlier means a smaller (doc_id, line), a null doc_id counting as the largest number.  Words are runs of anything but
    ASCII white space, A-Z lower-cased.  A line that goes still removes later ones.  Rows that repeat an id stand at the
    same places, so none of them is earlier than the other, and a place stays if the line of one of them does.
    """
    with scratch(documents.sparkSession) as keep:
        table = _line_table(documents, _levels(documents), percent)
        heads = table.groupBy("mark").agg(F.min(F.struct("doc", "line", "n", "keys", "b0", "b1")).alias("h"))
        heads = materialize(heads.select("h.*"))
        frequent = _cells(materialize(_postings(heads, percent)).withColumn("asked", F.lit(True)))
        found = materialize(_bucket_candidates(heads, percent, FIRST).union(_candidates(frequent, percent, FIRST)))
        near = materialize(_verified(documents, found.where("doc_y IS NOT NULL"), percent))
        open_ = found.where("doc_y IS NULL").select(F.col("doc_x").alias("doc"), F.col("line_x").alias("line"), "key").distinct().join(near, ["doc", "line"], "left_anti")
        open_ = materialize(open_)
        if not open_.isEmpty():
            held = bit_filter(open_.select(F.expr(f"key % {1 << FILTER_BITS}").alias("slot")), "slot")
            rest = _postings(heads, percent, held).join(open_.select("key").distinct(), "key", "left_semi").join(open_.withColumn("asked", F.lit(True)), ["doc", "line", "key"], "left")
            rest = _cells(rest.withColumn("asked", F.coalesce("asked", F.lit(False))))
            near = near.union(_verified(documents, _candidates(rest, percent, None), percent)).distinct()
        return keep(heads.select("doc", "line").join(near, ["doc", "line"], "left_anti"))


def _worded(line: str | bytes) -> bool:
    return bool(line.split() if isinstance(line, bytes) else line.encode("utf-8").split())


def removed_lines(documents: DataFrame, first: DataFrame) -> DataFrame:
    """doc, line of the lines with a word that are not among the first ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts, ends = word_counts(texts), np.cumsum(line_counts(texts))
            lines = [np.flatnonzero(counts[a:b]).astype(np.int32) for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.int32()))], names=["doc", "lines"])

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("doc")
    every = documents.select(own, "text").mapInArrow(run, "doc long, lines array<int>")
    held = every.join(_by_document(first), "doc", "left")
    return held.select("doc", F.explode(F.array_except("lines", F.coalesce("kept", F.array().cast("array<int>")))).alias("line")).distinct()


def _by_document(first: DataFrame) -> DataFrame:
    return first.groupBy("doc").agg(F.collect_set("line").alias("kept"))  # one document's own lines


def drop_lines(documents: DataFrame, first: DataFrame, length: str | None = None) -> DataFrame:
    """The documents with their first lines and their lines without a word, all columns kept.

    A document that loses all its words goes.  ``length`` names a column to hold a changed text's length.
    """
    schema, at = documents.schema, documents.columns
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST))
    doc, lines_kept = fresh(documents, "__doc"), fresh(documents, "__kept")
    held = documents.withColumn(doc, own).join(_by_document(first).select(F.col("doc").alias(doc), F.col("kept").alias(lines_kept)), doc, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sizes, stay = batch.column(at.index("text")).to_pylist(), batch.column(at.index(length)).to_pylist() if length else [], []
            for row, (text, kept) in enumerate(zip(texts, batch.column(len(at)).to_pylist())):
                lines = (text or "").split("\n")
                kept = set(kept or ())
                worded = [_worded(line) for line in lines]
                left = [line for i, line in enumerate(lines) if i in kept or not worded[i]]
                stay.append(not any(worded) or bool(kept))
                if len(left) < len(lines):
                    texts[row] = "\n".join(left)
                    if length:
                        sizes[row] = len(texts[row])
            columns = list(batch.columns[:len(at)])
            columns[at.index("text")] = pa.array(texts, columns[at.index("text")].type)
            if length:
                columns[at.index(length)] = pa.array(sizes, columns[at.index(length)].type)
            yield pa.RecordBatch.from_arrays(columns, names=at).filter(pa.array(stay, pa.bool_()))

    return held.select(*[F.col(f"`{c}`") for c in at], lines_kept).mapInArrow(run, schema)
