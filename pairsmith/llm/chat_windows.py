"""Chat formatting in budgeted, turn-aligned windows.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``; its tokens are counted, and prefix sums of the counts choose
how many whole turns fit a window. Every window begins with the conversation's system turn, if there is one, and the
last ``history`` turns before it as far as they fit; both are repeats there, so their targets are masked. Targets are
the texts of assistant turns, each in the window that holds it for the first time.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm.base import mapped, slices, table
from pairsmith.llm.token_count import counter

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates. Texts get a backslash after their first character.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[]\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def parse_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for turn in text.split(OPEN)[1:]:
        role, _, body = turn.partition("\n")
        out.append((parse_role(role), unescape(body.removesuffix(CLOSE))))
    return out


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    @property
    def body(self) -> tuple[int, int]:
        """Where the text stands in the formatted turn."""
        return self.text.index("\n") + 1, len(self.text) - len(CLOSE)


@dataclass
class Windowed:
    number: int
    turns: list[Turn]
    repeated: int
    over: bool

    @property
    def text(self) -> str:
        return "".join(t.text for t in self.turns)

    @property
    def tokens(self) -> int:
        return sum(t.tokens for t in self.turns)

    @property
    def loss(self) -> list[dict[str, int]]:
        at, out = 0, []
        for i, t in enumerate(self.turns):
            if i >= self.repeated and t.role == "assistant":
                a, b = t.body
                out.append({"s": at + a, "e": at + b})
            at += len(t.text)
        return out


def windows(turns: Iterable[Turn], budget: int, history: int) -> Iterator[Windowed]:
    """Windows of one conversation, whose turns are read one at a time; one window is held at once."""
    system: list[Turn] = []
    fresh: list[Turn] = []
    shown: list[Turn] = []
    before: deque[Turn] = deque(maxlen=history)
    used, number, over = 0, 0, False
    for i, t in enumerate(turns):
        if fresh and used + t.tokens > budget:
            yield Windowed(number, shown + fresh, len(shown), over)
            number += 1
            before.extend(fresh)
            room = budget - t.tokens - sum(x.tokens for x in system)
            kept: list[Turn] = []
            for x in reversed(before):
                if any(x is y for y in system) or x.tokens > room:
                    break
                kept.insert(0, x)
                room -= x.tokens
            shown, fresh = system + kept, []
            used = sum(x.tokens for x in shown)
        if i == 0 and t.role == "system":
            system = [t]
        fresh.append(t)
        used += t.tokens
        over = used > budget
    if fresh:
        yield Windowed(number, shown + fresh, len(shown), over)


def chat_windows(df: DataFrame, tokenizer: str, budget: int = 512, history: int = 2) -> DataFrame:
    """conv_id, window (from 0), text, loss (spans of code points, end exclusive), n_turns, n_repeated (turns at the
    window's start that earlier windows had), n_tokens and over_budget, for the rows (conv_id, turn, role, text) of df.

    Turns go by turn, then role and text (nulls first); repeated rows are turns of their own; null role and text count
    as empty; null conv_id is a conversation of its own; no rows give no windows. A turn is never divided: one that is
    longer than the budget has a window to itself (with the system turn) and over_budget.

    Tokens are counted where the rows lie, before they are spread by conversation, so that the costly part of a
    conversation that holds a third of all rows is shared by all tasks. What is left to one task is to sum up counts and
    to join texts, turn by turn from sorted spillable rows, with one window in memory."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("n_turns", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])

    def formatted(part: pa.RecordBatch) -> tuple[list[str], list[str]]:
        roles = [r or "" for r in part.column("role").to_pylist()]
        return roles, [f"{OPEN}{format_role(r)}\n{escape(t or '')}{CLOSE}" for r, t in zip(roles, part.column("text").to_pylist(), strict=True)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.append_column("n", pa.array(c.count(formatted(part)[1]), pa.int64()))

    counted = rows.transform(mapped, count, "conv_id long, turn long, role string, text string, n long").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for conv, role, text, n in zip(part.column("conv_id").to_pylist(), *formatted(part), part.column("n").to_pylist(), strict=True):
                    yield conv, Turn(role, text, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, own in groupby(turns(batches), key=lambda x: x[0]):
            for x in windows((t for _, t in own), budget, history):
                held.append({"conv_id": conv, "window": x.number, "text": x.text, "loss": x.loss, "n_turns": len(x.turns), "n_repeated": x.repeated, "n_tokens": x.tokens, "over_budget": x.over})
                size += len(held[-1]["text"])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return counted.transform(mapped, run, "conv_id long, window long, text string, loss array<struct<s:long,e:long>>, n_turns long, n_repeated long, n_tokens long, over_budget boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from nothing
    but the windows of ``chat_windows``: their texts are parsed, repeats left out, spans cut from the texts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each window adds, parsed where the windows lie."""
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n, turns, loss, chars = [], [], [], []
                for r in part.to_pylist():
                    fresh = parse(r["text"])[r["n_repeated"] :]
                    n.append(len(fresh))
                    turns.append("".join(f"{role}\n{text}\n" for role, text in fresh))
                    loss.append("".join(unescape(r["text"][x["s"] : x["e"]]) for x in r["loss"]))
                    chars.append(len(r["text"]))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("window"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "window", "n", "turns", "loss", "chars"])

    rows = formatted.select("conv_id", "window", "text", "loss", "n_repeated").transform(mapped, parts, "conv_id long, window long, n long, turns string, loss string, chars long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
        out = []
        for conv, own in groupby(each, key=lambda r: r[0]):
            n = chars = loss_chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, _, more, text, target, size in own:
                n += more
                chars += size
                loss_chars += len(target)
                turns.update(text.encode())
                loss.update(target.encode())
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.transform(mapped, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(rows, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op9_chat_windows": op9_chat_windows}
ORACLE_SQL: dict[str, str] = {}
