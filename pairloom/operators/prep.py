"""Prompts and fixed-length id sequences: template, encode, truncate, pad, mask, unmask, decode."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

IGNORED = -100


@dataclass(frozen=True)
class Task:
    """Where a task's input and label are, and what is put around the input."""

    name: str
    text: str
    label: str
    instruction: str
    suffix: str = ""


# The four tasks' columns, and their instructions in four styles.
COLUMNS = {"CodeTrans": ("java", "cs"), "CodeSearchNet": ("code", "docstring"), "BFP": ("buggy", "fixed"), "CONCODE": ("nl", "code")}
LONG = {
    "CodeTrans": "Translate the following Java code into C#: ",
    "BFP": "Refactor or improve the following Java code: ",
    "CONCODE": "Generate Java code from the following English description: ",
}
SHORT = {"CodeTrans": "translate java-to-csharp: ", "CodeSearchNet": "summarize ruby: ", "BFP": "refactor java: ", "CONCODE": "generate java: "}
STYLES = {
    "marked": {**LONG, "CodeSearchNet": "Summarize: <lang=Ruby> <code> "},
    "sentence": {**LONG, "CodeSearchNet": "Summarize the following ruby code into clear, concise English. Return only one sentence (no code, no quotes): "},
    "short": SHORT,
    "tagged": {**LONG, "CodeSearchNet": "Summarize the following Ruby code into English.\n\n<language>Ruby</language>\n<code>\n"},
}
SUFFIXES = {"tagged": {"CodeSearchNet": "\n</code>"}}


def catalogue(style: str) -> dict[str, Task]:
    """The tasks with one style's instructions."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")
    return {k: Task(k, *c, STYLES[style][k], SUFFIXES.get(style, {}).get(k, "")) for k, c in COLUMNS.items()}


TASKS = catalogue("marked")


def task(name: str, known: dict[str, Task] = TASKS) -> Task:
    """The task of that name; an unknown one is refused."""
    if name not in known:
        raise ValueError(f"unknown task {name!r}; known: {', '.join(known)}")
    return known[name]


def prompt(c: Column, instruction: str, suffix: str = "") -> Column:
    """Instruction, text and suffix, without white space at both ends."""
    return X.strip(F.concat(F.lit(instruction), X.as_text(c), F.lit(suffix)))


def examples(df: DataFrame, spec: Task, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, task, text (prompt) and label of a task's table; all other columns are pruned."""
    return df.select(*keep, F.lit(spec.name).alias("task"), prompt(F.col(spec.text), spec.instruction, spec.suffix).alias("text"), X.as_text(F.col(spec.label)).alias("label"))


def assembled(tables: Mapping[str, DataFrame], known: dict[str, Task] = TASKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One dataset of several tasks' tables, each by its own columns, instruction and suffix. An unknown task is refused."""
    if not tables:
        raise ValueError("no tasks are given")
    return reduce(DataFrame.unionByName, [examples(df, task(name, known), keep) for name, df in tables.items()])


def word_ids(tokens: Column, size: int = 30_000, first: int = 3) -> Column:
    """Ids from 32 bits of each token's MD5: a stand-in for a vocabulary, which is given by the caller in real use."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size + first).cast("int"))


def truncated(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 for each real id up to length, then 0."""
    n = F.least(F.size(ids), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= n).cast("int"))


def masked(ids: Column, mask: Column, ignored: int = IGNORED) -> Column:
    """ids where the mask is 1, else the ignored value."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(ignored)))


def unmasked(ids: Column, pad: int = 0, ignored: int = IGNORED) -> Column:
    return F.transform(ids, lambda i: F.when(i == ignored, F.lit(pad)).otherwise(i))


def decoded(ids: Column, vocabulary: Column, specials: tuple[int, ...] = (0, 1, 2)) -> Column:
    """Tokens of ids joined by spaces, special ones skipped; vocabulary: a map from id to token."""
    kept = F.filter(ids, lambda i: ~i.isin(*specials))
    return F.array_join(F.transform(kept, lambda i: F.element_at(vocabulary, i)), " ")


def encoded(df: DataFrame, text: str, label: str, length: int, label_length: int | None = None, pad: int = 0, ids=word_ids) -> DataFrame:
    """df's other columns, input_ids, attention_mask and labels (padding ignored). ids: tokens to ids."""
    label_length = label_length or length
    kept = [c for c in df.columns if c not in (text, label)]
    own = df.select(*kept, ids(X.tokens(F.col(text))).alias("_x"), ids(X.tokens(F.col(label))).alias("_y"))
    target = masked(padded(F.col("_y"), label_length, pad), attention(F.col("_y"), label_length))
    return own.select(*kept, padded(F.col("_x"), length, pad).alias("input_ids"), attention(F.col("_x"), length).alias("attention_mask"), target.alias("labels"))
