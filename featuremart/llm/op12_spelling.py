"""Spelling variants of a corpus' words by a dictionary of trie-node pairs.

The words' prefixes are the nodes of a trie and their suffixes those of the reversed words' trie; both are numbered.
A word of L letters is then L + 1 integer pairs (prefix node, suffix node), one for every place to split it, and with the
letter at a place skipped, L such pairs. Two words differ by one replaced letter if they share a pair with a letter
skipped, and by one inserted or deleted letter if a skipping pair of one is a splitting pair of the other. Node
numbers are exact (no hashes), so the integer joins give exactly the neighbours.

Plan. Tasks count the words of their texts before any shuffle, so a frequent word is a few rows. Words are
numbered as a sorted stream: a word shares the nodes of its common prefix with the word before it, and the rest are
new. Words are dealt by range of their first ``LEAD`` letters, so neighbouring tasks' words differ in these; each task leaves
its first and last word's, and a scan of these (one row a task) joins the numbers. A pair with a skipped letter
has at most one word per letter of the alphabet, so no join has a hot key. A form's count is at least twice its
word's, so chains of forms have at most 62 steps and are followed by doubling in six rounds.

Defined cases: null texts have no words; a null id is the text ``null``; repeated rows count again; ids may be of any
type (their text counts); a text longer than ``PIECE`` letters is read piecewise between runs, with the same result; a
deletion may make a word empty or equal to others. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import materialize, read_table, ship

LETTERS = "a-zÀ-ÿ"  # after A-Z became a-z
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
SLIP = 97        # a run whose hash this divides loses a letter
LEAD = 64        # letters that deal words to tasks
PIECE = 1 << 20  # letters of a text read at a time
HELD = 1 << 17   # different words a task holds before it passes their counts on

_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")  # shorter runs never make a word
_GAP = re.compile(f"[^{LETTERS}]")


# -- words -------------------------------------------------------------------------------------------

def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that cut no run."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


def words_of(doc: str, text: str) -> Counter:
    """Words of a text with their numbers; ``doc`` is its id as text."""
    found: Counter = Counter()
    seed = zlib.crc32(f"{doc}:".encode())
    for piece in pieces(text.encode().lower().decode()):  # bytes.lower changes A-Z alone
        for run, n in Counter(_RUN.findall(piece)).items():
            h = zlib.crc32(run.encode(), seed)
            if h % SLIP == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < LEAST_LETTERS:
                    continue
            found[run] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words with at least ``LEAST_COUNT`` occurrences."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(counts: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()),
                                               pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                held.update(words_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                if len(held) > HELD:
                    yield made(held)
                    held = Counter()
        if held:
            yield made(held)

    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc"), F.col(text_col).alias("text"))
    return (texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


# -- trie nodes --------------------------------------------------------------------------------------

def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def number_nodes(words: DataFrame, col: str, out: str) -> DataFrame:
    """``words`` (different texts in ``col``) with ``out``: the numbers of the trie nodes of each prefix, from the empty
    one (0) to the whole word. Numbers of whole words grow with the words' order."""
    keep = [c for c in words.columns if c != col]
    kept = words.select(col, *keep)
    ordered = kept.repartitionByRange(F.substring(col, 1, LEAD)).sortWithinPartitions(col)
    ends = "__first string, __last string, __top long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", __part int, {out} array<bigint>, {ends}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = before = None
        nodes: list[int] = [0]
        top = 0
        types = None
        for batch in batches:
            listed = []
            for word in batch.column(0).to_pylist():
                if first is None:
                    first = before = word
                    shared = 0
                else:
                    shared = common(before, word)
                nodes = nodes[:shared + 1] + list(range(top + 1, top + 1 + len(word) - shared))
                top += len(word) - shared
                before = word
                listed.append(nodes)
            n = batch.num_rows
            types = [c.type for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, type=pa.int32()), pa.array(listed, type=pa.list_(pa.int64())),
                 pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                names=[*batch.schema.names, "__part", out, "__first", "__last", "__top"])
        if first is not None:  # what this task leaves to the next one
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, t) for t in types], pa.array([part], type=pa.int32()),
                 pa.array([nodes[:LEAD + 1]], type=pa.list_(pa.int64())), pa.array([first[:LEAD]]),
                 pa.array([before[:LEAD]]), pa.array([top], type=pa.int64())],
                names=[col, *keep, "__part", out, "__first", "__last", "__top"])

    rows = materialize(ordered.mapInArrow(run, schema), "nodes")
    offset, before, held, joined = 0, "", [0], []
    for r in rows.where("__top IS NOT NULL").orderBy("__first").collect():  # one row a task
        shared = held[1:common(before, r["__first"]) + 1]

        def whole(j: int) -> int:
            return 0 if j == 0 else shared[j - 1] if j <= len(shared) else offset + j

        joined.append((r["__part"], offset, shared))
        before, held = r["__last"], [whole(j) for j in r[out]]
        offset += r["__top"]
    spark = words.sparkSession
    parts = spark.createDataFrame(joined, "__part int, __offset bigint, __shared array<bigint>")
    number = F.transform(out, lambda j: F.when(j == 0, j).when(
        j <= F.size("__shared"), F.get("__shared", j.cast("int") - 1)).otherwise(j + F.col("__offset")))
    return rows.where("__top IS NULL").join(F.broadcast(parts), "__part").select(col, *keep, number.alias(out))


# -- neighbours --------------------------------------------------------------------------------------

def neighbours(words: DataFrame) -> DataFrame:
    """(id, other, other_n) for all pairs of ``words`` (id, n, prefixes, suffixes) at one edit, both ways round."""
    split = words.select("id", "n", F.inline(F.arrays_zip("prefixes", F.reverse("suffixes"))).alias("a", "b"))
    short = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    skip = words.select("id", "n", F.inline(F.arrays_zip(short("prefixes"), F.reverse(short("suffixes")))).alias("a", "b"))
    x = skip.select("a", "b", F.col("id").alias("x"), F.col("n").alias("xn"))
    replaced = x.join(skip, ["a", "b"]).where("x <> id").select(F.col("x").alias("id"), F.col("id").alias("other"),
                                                                F.col("n").alias("other_n"))
    # a letter of a double may be skipped in two places
    deleted = x.join(split, ["a", "b"]).select("x", "xn", "id", "n").distinct()
    both = F.array(F.struct(F.col("x").alias("id"), F.col("id").alias("other"), F.col("n").alias("other_n")),
                   F.struct(F.col("id").alias("id"), F.col("x").alias("other"), F.col("xn").alias("other_n")))
    return replaced.unionByName(deleted.select(F.inline(both)))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, form): the last of each chain, by doubling."""
    at = materialize(forms.select("id", F.col("form").alias("root")), "chains")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = at.join(on, "root", "left")
        after = materialize(longer.select("id", F.coalesce("next", "root").alias("root"),
                                          F.col("next").isNotNull().alias("moved")), "chains")
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        at = after.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = vocabulary(docs, id_col, text_col)
    forward = number_nodes(counted, "word", "prefixes")
    known = forward.select("word", "n", "prefixes", F.element_at("prefixes", -1).alias("id"), F.reverse("word").alias("drow"))
    words = materialize(number_nodes(known, "drow", "suffixes").drop("drow"), "dictionary")
    best = neighbours(words.select("id", "n", "prefixes", "suffixes")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("low"))).alias("best"))
    is_form = F.col("best.other_n") >= RATIO * F.col("n")
    found = materialize(
        words.select("id", "word", "n").join(best, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("best.low")).alias("form"), F.when(is_form, F.col("best.other_n")).alias("form_n")), "near")
    chains = roots(found.where("form IS NOT NULL").select("id", "form"))
    names = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends = names.toDF("root", "root_word")
    changed = found.where("form IS NOT NULL").join(names, "form").join(chains, "id").join(ends, "root").select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = found.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"),
                                               F.col("word").alias("root"), "n", "n_near", "form_n")
    return changed.unionByName(alone)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))
