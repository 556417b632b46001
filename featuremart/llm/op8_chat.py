"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, only that reply
trainable. What stands after the last assistant turn (or a conversation without one) becomes one
more example with nothing trainable, so that no turn is lost. The template is

    <|turn|>role<|text|>text<|end|>

and control strings inside roles and texts are escaped reversibly: a backslash is doubled, and a
control string gets a backslash after its first character.

Plan: rows are shuffled once by conversation and sorted by turn; a streaming pass over each sorted
partition holds one conversation's turns and formatted prefix and gives its examples one by one. They
are read back row by row, with the last text, a running hash and counts held. An example holds all
turns before its reply by definition, so a conversation's own text must fit into one task, and its
examples together are as long as the square of its turns; many equal conversations or one very common
first turn are different keys and spread.

Defined cases: null texts and roles are empty; the order of a conversation is (turn, nulls first;
role; text), which settles ties; repeated rows stay; a null conversation id is a conversation like
any other; a conversation without text still gives its example. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import read_table, ship, sorted_groups

# The template's marks and the control strings of common chat templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>"]
TARGET_ROLE = "assistant"

_TO_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ONE_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

EXAMPLES = "conv_id {id}, example int, n_turns int, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _ONE_TURN.findall(formatted)]


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(turns held, formatted, loss start, loss end) per assistant turn, then the rest, if any."""
    prefix, done = "", 0
    for n, (role, text) in enumerate(turns, 1):
        prefix += format_turn(role, text)
        if role == TARGET_ROLE:
            end = len(prefix) - len(END)
            yield n, prefix, end - len(escape(text)), end
            done = n
    if done < len(turns):
        yield len(turns), prefix, 0, 0


def examples(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """One row per example: the formatted text and its trainable span [loss_start, loss_end)."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[id_col]
    turns = (rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                         F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        for (conv,), parts in sorted_groups(batches, 1):
            turns = [t for p in parts for t in zip(p.column(2).to_pylist(), p.column(3).to_pylist())]
            for i, (n, text, a, b) in enumerate(expand(turns)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], type=parts[0].schema.field(0).type), pa.array([i], pa.int32()),
                     pa.array([n], pa.int32()), pa.array([text], pa.string()), pa.array([a], pa.int32()),
                     pa.array([b], pa.int32())],
                    names=["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"])

    return turns.mapInArrow(run, EXAMPLES.format(id=kind))


def digest(made: DataFrame) -> DataFrame:
    """Read the examples back: turns from the longest example, trainable text from every mask."""
    ship(made.sparkSession)
    kind = dict(made.dtypes)["conv_id"]
    rows = (made.select("conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end")
            .repartition("conv_id").sortWithinPartitions("conv_id", "example"))

    def done(conv, kind, loss, chars, loss_chars, last):
        n, whole = 0, hashlib.sha256()
        for m in _ONE_TURN.finditer(last):
            n += 1
            whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], type=kind), pa.array([n], pa.int64()), pa.array([whole.hexdigest()]),
             pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches):
        # row by row: what is held of a conversation is its hash, its counts and the last text
        kind, started, conv = None, False, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                key, text, a, b = (batch.column(i)[at].as_py() for i in (0, 3, 4, 5))
                if not started or key != conv:
                    if started:
                        yield done(conv, kind, loss, chars, loss_chars, last)
                    started, conv, loss, chars, loss_chars = True, key, hashlib.sha256(), 0, 0
                target = unescape(text[a:b])
                loss.update(target.encode())
                loss_chars += len(target)
                chars += len(text)
                last = text
        if started:
            yield done(conv, kind, loss, chars, loss_chars, last)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")


#: The contract's extra conversation: control strings inside texts.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(examples(rows))
