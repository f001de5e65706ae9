"""Filter interaction audit: what every order of five text filters removes, part by part.

Four filters look at a text alone, the fifth asks whether a smaller id has the same text.  That one is answered by radix
tries: a task puts the texts of a block into a compressed trie whose terminals hold the smallest id, so copies within a
block travel once; the terminals are range-partitioned by text prefixes that grow where a prefix holds too much, and a trie
per partition takes the full texts and the minimum over all blocks.  One text that is too much for a task on its own is
merged in salted rounds first.  Documents become five-bit masks, masks become counts, and the orders are read off the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch

FILTERS = "ABCDE"
BLOCK = 16 << 20  # bytes of text a map task holds at once
LIMIT = 32 << 20  # bytes of text of one prefix, and about those of one partition
LEAST = 256 << 10  # a prefix of less is not split, however many partitions there are
HEAD, WIDER = 32, 4  # code points of the first prefix; how much longer the next one is
FAN = 8  # copies of a text that one salted task merges at least

UPPER = bytes(range(0x41, 0x5B))
LATER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
MARKS = b"#$%&*|"


class Trie:
    """A compressed trie: a node is [bytes of its edge, children by first byte, number of the text that ends there or -1]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.low: list[int] = []  # smallest id of every text
        self.owner: list[int] = []  # the caller's number of the row that has it

    def add(self, text: bytes, low: int, row: int) -> int:
        """Number of the text; ``row`` becomes its owner if ``low`` is smaller than all before it."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, -1]
            elif not text.startswith(child[0], at):
                child = node[1][text[at]] = self._split(child, text, at)
            node, at = child, at + len(child[0])
        if node[2] < 0:
            node[2] = len(self.low)
            self.low.append(low)
            self.owner.append(row)
        elif low < self.low[node[2]]:
            self.low[node[2]], self.owner[node[2]] = low, row
        return node[2]

    @staticmethod
    def _split(child: list, text: bytes, at: int) -> list:
        edge, fits, breaks = child[0], 1, len(child[0])  # the first byte agrees
        while breaks - fits > 1:
            middle = (fits + breaks) // 2
            if text.startswith(edge[fits:middle], at + fits):
                fits = middle
            else:
                breaks = middle
        upper = [edge[:fits], {edge[fits]: child}, -1]
        child[0] = edge[fits:]
        return upper


def own_mask(text: bytes) -> int:
    """Bits 0 to 3 for filters A to D."""
    words = text.split()
    a = len(words) < 100
    b = 100 * len(set(words)) < 80 * len(words)
    c = 100 * (len(text) - len(text.translate(None, UPPER))) > 10 * len(text.translate(None, LATER))
    d = len(text.translate(None, MARKS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


BLOCKS = "id long, part string, mask int, term long, low long, bytes long, text string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with mask, the term (text of a block) they belong to and its smallest id; one row of a term carries the text."""
    from pyspark import TaskContext

    term = TaskContext.get().partitionId() << 40
    trie, rows, held = Trie(), [], 0

    def flush() -> pa.RecordBatch:
        out = []
        for k, (i, part, mask, place, text) in enumerate(rows):
            first = place >= 0 and trie.owner[place] == k
            out.append((i, part, mask, *((None, None) if place < 0 else (term + place, trie.low[place])), len(text) if first else None, text if first else None))
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)] + [pa.array(columns[6], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        ids, parts, texts = (batch.column(n) for n in ("id", "part", "text"))
        for k in range(batch.num_rows):
            text = texts[k].as_buffer()
            text = b"" if text is None else text.to_pybytes()
            i = ids[k].as_py()
            place = -1 if i is None else trie.add(text, i, len(rows))
            rows.append((i, parts[k].as_py(), own_mask(text), place, text))
            held += len(text) + 200
            if held >= BLOCK:
                yield flush()
                term += len(trie.low)
                trie, rows, held = Trie(), [], 0
    if rows:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, winner, best) of every term of a partition: the term of the same text with the smallest id, and that id."""
    trie, terms, lows, places = Trie(), [], [], []
    for batch in batches:
        texts = batch.column("text")
        for k, (term, low) in enumerate(zip(batch.column("term").to_pylist(), batch.column("low").to_pylist())):
            places.append(trie.add(texts[k].as_buffer().to_pybytes(), low, len(terms)))
            terms.append(term)
            lows.append(low)
    found = [(t, terms[trie.owner[p]], trie.low[p]) for t, p in zip(terms, places)]
    for at in range(0, len(found), 1 << 16):
        columns = zip(*found[at:at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "winner", "best"])


def _keyed(terms: DataFrame, limit: int) -> DataFrame:
    """``terms`` with ``key``, the shortest prefix of HEAD, HEAD x WIDER, ... code points that holds at most ``limit`` bytes, or the text."""
    size, out = HEAD, terms.withColumn("key", F.substring("text", 1, HEAD))
    while True:
        longer = out.where((F.length("key") == size) & (F.length("text") > size))
        heavy = materialize(longer.groupBy("key").agg(F.sum("bytes").alias("held")).where(F.col("held") > limit).select("key", F.lit(True).alias("heavy")))
        if heavy.isEmpty():
            return out
        size *= WIDER
        out = out.join(heavy, "key", "left").withColumn("key", F.when(F.col("heavy"), F.substring("text", 1, size)).otherwise(F.col("key"))).drop("heavy")


def smallest(terms: DataFrame) -> DataFrame:
    """(term, best) of the terms (term, low, bytes, text) of which another one has the same text and a smaller ``low``."""
    spark = terms.sparkSession
    total = terms.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // LIMIT))
    limit = min(LIMIT, max(LEAST, total // (2 * tasks)))
    keyed = _keyed(terms, limit)
    dealt = lambda df, *by: df.select("term", "low", F.col("text").cast("binary").alias("text"), *by).repartitionByRange(tasks, *by).mapInArrow(_merge, "term long, winner long, best long")
    whole = keyed.where(F.col("key") == F.col("text")).groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("held"))
    salts = F.least(F.ceil(F.col("held") / limit), F.ceil(F.col("n") / FAN))
    hot = materialize(whole.where((F.col("held") > limit) & (F.col("n") > FAN)).select("key", salts.alias("salts")))
    if hot.isEmpty():
        merged = dealt(keyed, "key").join(terms.select("term", "low"), "term")
        return merged.where("best < low").select("term", "best")
    first = materialize(dealt(keyed.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("term"), "salts")), "key", "salt"))
    rest = keyed.join(hot.select("key"), "key", "left_anti").select("term", "low", "bytes", "text")
    winners = terms.join(first.where("term = winner").select("term"), "term", "left_semi").select("term", "low", "bytes", "text")
    best = materialize(smallest(materialize(rest.unionByName(winners))))
    later = best.withColumnsRenamed({"term": "winner", "best": "later"})
    mapped = first.where("term <> winner").join(later, "winner", "left").select("term", F.coalesce("later", "best").alias("best"))
    return best.unionByName(mapped.join(terms.select("term", "low"), "term").where("best < low").select("term", "best"))


def masks(documents: DataFrame) -> DataFrame:
    """id, part and five-bit mask of every document (id, part, text): a bit is set where the filter of that letter removes it."""
    # blocks are numbered by task, so they are written once before anything is joined on the numbers
    blocks = materialize(documents.select("id", "part", F.col("text").cast("binary").alias("text")).mapInArrow(_blocks, BLOCKS))
    best = materialize(smallest(blocks.where("text IS NOT NULL").select("term", "low", "bytes", "text")))
    rows = blocks.select("id", "part", "mask", "term", "low")
    with_id = rows.where("id IS NOT NULL").join(best, "term", "left")
    again = F.when(F.col("id") > F.coalesce("best", "low"), 1 << 4).otherwise(0)
    return with_id.select("id", "part", F.col("mask").bitwiseOR(again).alias("mask")).unionByName(rows.where("id IS NULL").select("id", "part", "mask"))


def _by_mask(value: Column) -> Column:
    return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, value)), F.lit(0)) for m in range(1 << len(FILTERS))])


def interactions(marked: DataFrame) -> DataFrame:
    """The audit of documents (part, mask, good, toxic): one row per part, order of the filters and step."""
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(*[_by_mask(F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    # bits of the filters before the step, and of its own
    steps = steps.withColumn("bits", F.expr("transform(split(filter_order, ''), x -> shiftleft(1, ascii(x) - 65))"))
    steps = steps.withColumns({"own": F.element_at("bits", F.col("step")), "before": F.expr("aggregate(slice(bits, 1, step - 1), 0, (s, x) -> s | x)")})
    total = lambda of, when, times="1": F.expr(f"aggregate(sequence(0, {(1 << len(FILTERS)) - 1}), 0L, (s, m) -> s + if({when}, {of}[m] * {times}, 0L))")
    removed = "(m & before) = 0 AND (m & own) <> 0"
    orders_each = "if(m = 0, 0, div(120, bit_count(m)))"  # orders in which this filter comes first among those that a mask fails
    return steps.select(
        "part", "filter_order", "step", total("n", "(m & (before | own)) = 0").alias("kept"), total("n", removed).alias("removed"),
        total("n", "(m & before) <> 0 AND (m & own) <> 0").alias("redundant"), total("n", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("n", "(m & own) <> 0", orders_each).alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``documents``: doc_id, text, lang; ``labels``: doc_id, quality, toxic; other columns are ignored.  A null text is empty,
    a null lang the part ''.  A null doc_id is neither smaller than another id nor has it smaller ones, so its row never fails
    E and never makes another fail; it has no label.  Rows with equal ids and texts count one by one and don't fail E through
    each other.  A document is good (toxic) if any of its label rows says so.  An empty table gives no rows.
    """
    with scratch(documents.sparkSession) as keep:
        marked = masks(documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), "text"))
        said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        with_id = marked.where("id IS NOT NULL").join(said, "id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        without = marked.where("id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
        return keep(interactions(with_id.unionByName(without)))
