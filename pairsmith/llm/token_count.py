"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other. The splitter reads character classes and emits a mark where a
pre-token begins; texts are cut into chunks, each chunk becomes a map from entry state to exit state, the maps compose
in a parallel prefix scan, and a second pass emits the marks. The merger reads the bytes of a pre-token; each of its
transitions is annotated with the number of tokens up to there, and its states are compiled for the pre-tokens of a
batch that were not seen before.

The merger rests on a property of byte-pair encoding: the tokens of a prefix are the tokens of a shorter prefix plus
one more, and that last token is the only suffix token which the rules never join with the token before it.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pairsmith.llm.base import mapped, slices, table
from pairsmith.llm.merges import Borders, Trie

#: Characters with the Unicode property White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Classes of characters. The letters that end a contraction have a class each; END stands between texts.
SPACE, OTHER_WHITE, LETTER, NUMBER, OTHER, QUOTE, END = range(7)
TAIL = {c: 7 + i for i, c in enumerate("stmdrvle")}
CLASSES = 7 + len(TAIL)
#: States: what the pre-token read so far is.
START, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, AFTER_R, AFTER_V, AFTER_L, CLOSED = range(13)
STATES = 13
#: Marks: a pre-token begins at this character, at the one before it.
HERE, BEFORE = 1, 2
CHUNK = 256
#: Bytes of new pre-tokens that are compiled at a time; longer ones go alone; pre-tokens that are remembered.
COMPILED, LONG, KNOWN = 1 << 17, 256, 300_000


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE)] = OTHER_WHITE
    out[32], out[ord("'")], out[0x110000] = SPACE, QUOTE, END
    for c, k in TAIL.items():
        out[ord(c)] = k
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by class * STATES + state."""
    to, marks = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)

    def fresh(k: int, spaced: bool) -> int:
        """The state of a pre-token that begins with this class, or joins one space before it."""
        if k == QUOTE:
            return IN_OTHERS if spaced else AT_QUOTE
        return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE, OTHER_WHITE: ONE_WHITE, END: START}.get(k, IN_LETTERS)

    for k in range(CLASSES):
        white, letter = k in (SPACE, OTHER_WHITE), k == LETTER or k >= 7
        for q in range(STATES):
            new = (fresh(k, False), HERE)
            if k == END or q in (START, CLOSED):
                got = new
            elif q in (ONE_SPACE, RUN_SPACE, ONE_WHITE, RUN_WHITE) and white:
                got = (RUN_SPACE if k == SPACE else RUN_WHITE, 0)
            elif q == ONE_SPACE:
                got = (fresh(k, True), 0)
            elif q == RUN_SPACE:
                got = (fresh(k, True), BEFORE)
            elif q == RUN_WHITE:
                got = (new[0], HERE | BEFORE)
            elif q == IN_LETTERS and letter or q == IN_NUMBERS and k == NUMBER or q in (IN_OTHERS, AT_QUOTE) and k in (OTHER, QUOTE):
                got = ({AT_QUOTE: IN_OTHERS}.get(q, q), 0)
            elif q == AT_QUOTE and k in (TAIL[c] for c in "stmd"):
                got = (CLOSED, 0)
            elif q == AT_QUOTE and k in (TAIL[c] for c in "rvl"):
                got = ({TAIL["r"]: AFTER_R, TAIL["v"]: AFTER_V, TAIL["l"]: AFTER_L}[k], 0)
            elif q in (AFTER_R, AFTER_V) and k == TAIL["e"] or q == AFTER_L and k == TAIL["l"]:
                got = (CLOSED, 0)
            elif q in (AFTER_R, AFTER_V, AFTER_L) and letter:
                got = (IN_LETTERS, BEFORE)
            else:
                got = new
            if q in (AFTER_R, AFTER_V, AFTER_L) and got[0] not in (CLOSED,) and not letter:
                got = (got[0], got[1] | BEFORE)
            to[k, q], marks[k, q] = got
    return to.ravel(), marks.ravel()


def starts(codes: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens (and the END marks between texts) begin."""
    n = len(codes)
    to, marks = splitter()
    columns = np.full(-(-max(n, 1) // CHUNK) * CHUNK, END, np.uint8)
    columns[:n] = classes()[codes]
    columns = columns.reshape(-1, CHUNK).T.astype(np.uint16) * STATES
    columns = np.ascontiguousarray(columns)
    many = columns.shape[1]
    exits = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], many, axis=1)
    for column in columns:
        exits = to[column + exits]
    scanned, step = np.ascontiguousarray(exits.T), 1
    while step < many:  # each round composes maps of twice as many chunks
        scanned[step:] = np.take_along_axis(scanned[step:], scanned[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate(([START], scanned[:-1, START])).astype(np.uint8)
    out = np.empty((CHUNK, many), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        out[i], state = marks[at], to[at]
    flat = out.T.ravel()
    begins = (flat[:n] & HERE) != 0
    if n > 1:
        begins[:-1] |= (flat[1:n] & BEFORE) != 0
    if n and len(flat) > n and flat[n] & BEFORE:
        begins[-1] = True
    return np.flatnonzero(begins)


class Merger:
    """The transducer over bytes, compiled for the pre-tokens of a batch: a state for each of their prefixes, with its last
    token; a transition for each next byte, annotated with the change in the number of tokens.

    A transition's target is found among the tokens that end with its byte: the one that no merge joins to the last token
    of the state it begins at. All transitions from one place of the pre-tokens are compiled at once."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        size = max(vocab.values()) + 1
        halves, when = np.zeros((2, size), np.int64), np.full(size, -1.0)
        ranks: dict[tuple[int, int], float] = {}
        whole = {}
        for r, (a, b) in enumerate(merges):
            if (pair := (vocab[a], vocab[b])) not in ranks and (t := vocab.get(a + b)) is not None:
                ranks[pair] = r
                if t not in whole:
                    whole[t] = pair
                    halves[:, t], when[t] = pair, r
        self.borders = Borders(ranks, when, halves)
        ids = np.fromiter(whole, np.int64, len(whole))
        early = dict(zip(ids.tolist(), self.borders.crossed(*halves[:, ids], after_first=True).tolist(), strict=True))
        live = {t for b, t in vocab.items() if len(b) == 1}
        for t, (a, b) in whole.items():  # in the order of merges: halves come before what they make
            if not early[t] and a in live and b in live:
                live.add(t)
        self.trie = Trie({b.decode("latin-1"): t for b, t in vocab.items() if t in live})

    def tokens(self, pieces: list[bytes]) -> list[int]:
        """The number of tokens of each piece: the sum of the changes on its way. Pieces of similar lengths are quickest."""
        trie, data = self.trie, np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")  # those that go on come first
        begins = (np.cumsum(size) - size)[order]
        going = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1))
        last, total = np.full(len(data) + 1, -1), np.zeros(len(data) + 1, np.int64)  # of all states, the start being the first
        out, state, first, made = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0, 1
        # tokens that may go on, by state: the state they began at and their node
        begun, node, cuts = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(2, np.int64)
        for i, n in enumerate(going[:-1].tolist()):
            key, own = np.unique(state[:n] << 8 | data[begins[:n] + i], return_inverse=True)
            before, new = key >> 8, np.arange(len(key))
            many = cuts[before + 1] - cuts[before]
            owner = np.repeat(new, many)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + cuts[before][owner]
            owner, start, node = np.concatenate((owner, new)), np.concatenate((begun[at], first + before)), np.concatenate((node[at], np.zeros(len(new), np.int64)))
            letter = trie.of_char[key & 255][owner]
            to = trie.base[node] + letter
            alive = (letter > 0) & (trie.parent[to] == node)
            owner, start, node = owner[alive], start[alive], to[alive]
            ends = np.flatnonzero(trie.token[node] >= 0)
            token = trie.token[node[ends]].astype(np.int64)
            good = ~self.borders.joins(last[start[ends]], token)
            to, token = made + owner[ends[good]], token[good]
            last[to], total[to] = token, total[start[ends[good]]] + 1
            if last[made : made + len(key)].min() < 0:
                raise ValueError("bytes without a token")
            done = going[i + 1]
            out[order[done:n]] = total[made + own[done:]]
            order_of = np.argsort(owner, kind="stable")
            begun, node, cuts = start[order_of], node[order_of], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(key)))))
            state, first, made = own, made, made + len(key)
        return out.tolist()

    def alone(self, piece: bytes) -> int:
        """As ``tokens``, for a piece too long to go place by place with others."""
        base, parent, token, of_char = self.lists
        last, total, going = [-1], [0], []
        known: dict[int, bool] = {}
        for i, b in enumerate(piece):
            letter, more = of_char[b], []
            found = None
            for start, node in [*going, (i, 0)]:
                to = base[node] + letter
                if not letter or parent[to] != node:
                    continue
                more.append((start, to))
                if found is None and (t := token[to]) >= 0:
                    key = last[start] << 24 | t
                    if (joins := known.get(key)) is None:
                        joins = known[key] = bool(self.borders.joins(np.array([last[start]]), np.array([t]))[0])
                    if not joins:
                        found = (t, total[start] + 1)
            if found is None:
                raise ValueError("bytes without a token")
            last.append(found[0])
            total.append(found[1])
            going = more
        return total[-1]

    @functools.cached_property
    def lists(self) -> tuple[list[int], ...]:
        return self.trie.base.tolist(), self.trie.parent.tolist(), self.trie.token.tolist(), self.trie.of_char[:256].tolist()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.merger = Merger(vocab, merges)
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those there are."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        counts, parts, owner = [], [], []
        for i, text in enumerate(texts):
            split, special = self.parts(text) if text else ([], 0)
            counts.append(special)
            parts += split
            owner += [i] * len(split)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        codes = np.full(offsets[-1], 0x110000, np.uint32)
        for p, o, n in zip(parts, offsets.tolist(), lengths.tolist(), strict=False):
            codes[o : o + n] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = starts(codes)
        bounds = np.searchsorted(begins, offsets).tolist()
        flat: list[str] = []
        ends = [0]
        for k, p in enumerate(parts):
            at = (begins[bounds[k] : bounds[k + 1]] - offsets[k]).tolist()  # the last is the END mark
            flat += [p[a:b] for a, b in pairwise(at)]
            ends.append(len(flat))
        got = list(map(self.known.get, flat))
        missing = [i for i, n in enumerate(got) if n is None]
        found = self.learned({flat[i] for i in missing})
        for i in missing:
            got[i] = found[flat[i]]
        for k, (a, b) in enumerate(pairwise(ends)):
            counts[owner[k]] += sum(got[a:b])
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known.update((p, n) for p, n in found.items() if len(p) <= 32)
        return counts

    def learned(self, pieces: set[str]) -> dict[str, int]:
        """Token counts of new pre-tokens, about COMPILED bytes of them at a time, short ones first."""
        out: dict[str, int] = {}
        held, size = [], 0
        for p in sorted(pieces, key=len):
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                out[p] = self.merger.alone(raw)
                continue
            out[p] = 0
            held.append((p, raw))
            size += len(raw)
            if size >= COMPILED:
                out.update(zip((p for p, _ in held), self.merger.tokens([r for _, r in held]), strict=True))
                held, size = [], 0
        out.update(zip((p for p, _ in held), self.merger.tokens([r for _, r in held]), strict=True))
        return out


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    tokenizer: path of a byte-level BPE file of the tokenizers library. Special strings in a text count one token each,
    as that library does by default. Null text counts as empty: 0 bytes, 0 tokens; an
    empty table gives an empty one. Rows stay as they are, repeated
    ones too; no row is moved between partitions, so a hot key costs nothing. Memory: about 4 MB of text at a time
    (or one text, if longer), and bounded tables of known pre-tokens and states."""
    out = pa.schema([*((pa.field(c, pa.int64())) for c in keep), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = pc.fill_null(part.column("_text"), "")
                n = pa.array(c.count(texts.to_pylist()), pa.int64())
                yield pa.record_batch([*(part.column(k).cast(pa.int64()) for k in keep), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], schema=out)

    ddl = ", ".join([*(f"`{k}` long" for k in keep), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return df.select(*keep, df[text].alias("_text")).transform(mapped, run, ddl)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
