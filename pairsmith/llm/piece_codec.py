"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

Three machines are compiled from the model file and composed with each input: the normaliser (a leading space, spaces
written as U+2581), the pieces (a trie over their characters), and the byte fallback for characters that are no piece.
Arcs of the composition are pieces over spans of the text; a state is a place in the text with the piece that ends
there. An arc weighs the piece's negated score, and infinity if the model's merges would join the piece to the one
before it. Weights add up along a path and at each state the least sum is kept (the tropical semiring); the path of
least weight is the model's own segmentation. The composition is cut into units where no piece can cross: before space
marks and between letters and other characters. Paths of units are memoised; all new units of a batch are composed and
relaxed together, place by place.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pairsmith.llm.base import mapped, slices, table
from pairsmith.llm.merges import Borders, Trie

SPACE = "▁"
INFINITY = float("inf")
#: Units of more characters are cut wherever no piece crosses; parts of more characters are relaxed on their own.
LONG = 64
#: Characters of new units that are composed at a time.
COMPOSED = 1 << 17
#: Units that are memoised, in each of two generations, so that common units stay.
KNOWN = 200_000
#: In place of a piece: a character that becomes bytes.
BYTES = -2
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.cost = np.array([-model.get_score(i) for i in range(len(self.pieces))], np.float64)
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[p] = i
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.written = pa.array([bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.binary())
        halves, when = np.zeros((2, len(self.pieces)), np.int64), np.full(len(self.pieces), -1.0)
        live = {}  # pieces that merges can make
        for p, i in self.id.items():
            if len(p) > 1:
                when[i] = self.cost[i]
                if (parts := self.parts_of(p)) is None:
                    continue
                halves[:, i] = parts
            live[p] = i
        self.trie = Trie(live)
        self.borders = Borders({(self.id[p[:k]], self.id[p[k:]]): self.cost[i] for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}, when, halves)
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in live if len(p) == 1]] = True
        self.beside = {p[i : i + 2] for p in live for i in range(len(p) - 1)}  # pairs of characters within pieces
        self.unit = self.units()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts_of(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes a piece out of its characters; None if it is never made."""
        parts, last = list(piece), None
        while len(parts) > 1:
            steps = [(self.cost[w], i) for i in range(len(parts) - 1) if (w := self.id.get(parts[i] + parts[i + 1])) is not None]
            if not steps:
                return None
            i = min(steps)[1]
            last = (self.id[parts[i]], self.id[parts[i + 1]]) if parts[i] in self.id and parts[i + 1] in self.id else None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def units(self) -> re.Pattern[str]:
        """Runs with the space marks before them that no piece crosses: of letters and of other characters, if no piece mixes
        them; up to the next space mark; or whole texts."""
        letter = re.compile(r"[^\W\d_]")
        letter = re.compile(r"[^\W\d_]")
        inner = [x for x in self.beside if SPACE not in x]
        more = {c for x in inner if bool(letter.match(x[0])) != bool(letter.match(x[1])) for c in x if letter.match(c)}  # count as others
        kinds = {c: bool(letter.match(c)) and c not in more for x in inner for c in x}
        if any(x[1] == SPACE != x[0] for x in self.beside):
            return re.compile(".+", re.S)
        if any(kinds[x] != kinds[y] for x, y in inner):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        others = re.escape("".join(sorted(more)))
        return re.compile(rf"{SPACE}*[^\W\d_{others}]+|{SPACE}*(?:(?!{SPACE})[\W\d_{others}])+|{SPACE}+")

    @staticmethod
    def normalise(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def weights(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of arcs for a piece after another one (or after bytes, which merge with nothing)."""
        return np.where(self.borders.joins(before, piece), INFINITY, self.cost[piece])

    def relaxed(self, units: list[str]) -> list[bytes]:
        """The piece ids, four bytes each, on the path of least weight through each unit.

        States are places in the units (the least sum of weights up to there, the last arc's piece and its start); all arcs
        that begin at the n-th place of their unit are relaxed at once, from the first place on."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        place = np.arange(len(codes)) - np.repeat(end - size, size)
        start, last, piece = self.trie.arcs(self.trie.of_char[codes], np.repeat(end, size) - np.arange(len(codes)))
        strange = np.flatnonzero(~self.single[codes])  # arcs of the byte fallback
        start, last, piece = np.concatenate((start, strange)), np.concatenate((last, strange)), np.concatenate((piece.astype(np.int64), np.full(len(strange), BYTES)))
        order = np.argsort(place[start], kind="stable")
        start, last, piece = start[order], last[order], piece[order]
        cuts = np.searchsorted(place[start], np.arange(int(size.max()) + 1)).tolist()
        least, arc, came = np.full(len(codes), INFINITY), np.full(len(codes), BYTES), np.full(len(codes), -1)
        for n in range(len(cuts) - 1):
            s, e, t = (x[cuts[n] : cuts[n + 1]] for x in (start, last, piece))
            real = np.maximum(t, 0)
            weight = self.weights(arc[s - 1], real) if n else self.cost[real]
            total = np.where(t < 0, 0.0, weight) + (least[s - 1] if n else 0.0)
            better = total < least[e]  # arcs from one place end at different places: no two write to one state
            e = e[better]
            least[e], arc[e], came[e] = total[better], t[better], s[better]
        on, at = np.zeros(len(codes), bool), end - 1
        while len(at):
            on[at] = True
            at = came[at]
            at = at[place[at] > 0] - 1
        ends = np.cumsum(on)[end - 1]
        ids = arc[on]
        if len(strange := np.flatnonzero(ids == BYTES)):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[on][strange].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[strange] = list(map(len, raw))
            ends = np.cumsum(wide)[ends - 1]
            at = np.repeat(ids == BYTES, wide)
            ids = np.repeat(ids, wide)
            ids[at] = [self.byte[b] for x in raw for b in x]
        data, ends = ids.astype(np.int32).tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def alone(self, unit: str) -> bytes:
        """As ``relaxed``, for a part too long to go place by place with others."""
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, last, piece = self.trie.arcs(self.trie.of_char[codes], np.arange(len(codes), 0, -1))
        strange = np.flatnonzero(~self.single[codes])
        start, last, piece = np.concatenate((start, strange)), np.concatenate((last, strange)), np.concatenate((piece, np.full(len(strange), BYTES)))
        order = np.argsort(start, kind="stable")
        least, arc, came = [INFINITY] * len(codes), [BYTES] * len(codes), [0] * len(codes)
        known: dict[int, float] = {}
        cost = self.cost.tolist()
        for s, e, t in zip(start[order].tolist(), last[order].tolist(), piece[order].tolist(), strict=True):
            if t < 0:
                weight = 0.0
            elif s == 0 or (p := arc[s - 1]) < 0:
                weight = cost[t]
            elif (weight := known.get(p << 24 | t)) is None:
                weight = known[p << 24 | t] = float(self.weights(np.array([p]), np.array([t]))[0])
            total = weight + (least[s - 1] if s else 0.0)
            if total < least[e]:
                least[e], arc[e], came[e] = total, t, s
        out, e = [], len(codes) - 1
        while e >= 0:
            out.append([arc[e]] if arc[e] >= 0 else [self.byte[b] for b in unit[e].encode("utf-8", "surrogatepass")])
            e = came[e] - 1
        return np.array([t for ids in reversed(out) for t in ids], np.int32).tobytes()

    def parts(self, unit: str) -> list[str]:
        """A unit, cut where no piece crosses if it is long: the parts have paths of their own."""
        if len(unit) <= LONG:
            return [unit]
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.beside), len(unit)]
        return [unit[a:b] for a, b in pairwise(cuts)]

    def learn(self, units: list[str]) -> None:
        """Paths of units that are not known, about COMPOSED characters at a time, short ones first."""
        units = sorted(units, key=len)
        at = 0
        while at < len(units) and len(units[at]) <= LONG:
            n, size = at, 0
            while n < len(units) and len(units[n]) <= LONG and size < COMPOSED:
                size += len(units[n])
                n += 1
            self.known.update(zip(units[at:n], self.relaxed(units[at:n]), strict=True))
            at = n
        self.known.update((u, self.alone(u)) for u in units[at:])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text, four bytes each."""
        found = [self.unit.findall(self.normalise(t)) for t in texts]
        flat = list(chain.from_iterable(found))
        got = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(got) if x is None]
        units = {flat[i] for i in missing}
        long = {u: self.parts(u) for u in units if len(u) > LONG}
        units.difference_update(long)
        units.update(p for parts in long.values() for p in parts if p not in self.known)
        again = units.intersection(self.older)
        self.known.update((u, self.older[u]) for u in again)
        self.learn(list(units - again))
        known = self.known
        whole = {u: b"".join(map(known.__getitem__, parts)) for u, parts in long.items()}
        for i in missing:
            got[i] = whole[u] if (u := flat[i]) in whole else known[u]
        ends = [0, *accumulate(map(len, found))]
        if len(known) > KNOWN:
            self.older, self.known = {u: x for u, x in known.items() if len(u) <= LONG}, {}
        return [b"".join(got[a:b]) for a, b in pairwise(ends)]

    def rest(self) -> None:
        """Between tasks only one generation of units stays."""
        if self.known:
            self.older, self.known = {u: x for u, x in self.known.items() if len(u) <= LONG}, {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space marks become spaces, the leading one goes, runs of byte pieces are read as UTF-8."""
        return self.decoded(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids[ends[i] : ends[i + 1]], read from a table of pieces all at once."""
        got = self.written.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1][ends] if len(ids) else np.zeros(len(ends), np.int32)
        data = np.frombuffer(got.buffers()[2], np.uint8)[: int(at[-1])] if len(ids) else np.empty(0, np.uint8)
        first = at[:-1][np.diff(at) > 0]
        first = first[(data[first] == 32) & ~np.isin(ids[ends[:-1]][np.diff(ends) > 0], list(self.of_byte))] if len(first) else first
        keep = np.ones(len(data), bool)
        keep[first] = False
        at = at - np.concatenate(([0], np.cumsum(~keep)))[at]
        raw = data[keep].tobytes()
        try:
            raw.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        if good and not np.any(np.frombuffer(raw, np.uint8)[at[:-1][at[:-1] < len(raw)]] & 0xC0 == 0x80):
            return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])
        return pa.array([raw[a:b].decode("utf-8", "each_byte") for a, b in pairwise(at.tolist())], pa.string())


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_chars, n_pieces, ids, decoded (the text read back from ids) and exact (decoded = text).

    model: path of a SentencePiece BPE model with byte fallback. Null text counts as empty: no ids, decoded empty; an
    empty table gives an empty one. Whole texts; rows stay in their partitions, so neither hot keys nor repeated rows matter. exact is false only for texts
    that hold U+2581 themselves, which the model writes as a space. Memory: half a megabyte of text at a time (or one text, if
    longer) and bounded tables of known units."""
    kept = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                texts = pc.fill_null(part.column("_text"), "")
                packed = c.packed(texts.to_pylist())
                ids = np.frombuffer(b"".join(packed), np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                back = c.decoded(ids, ends)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pc.utf8_length(texts).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), back, pc.equal(back, texts)],
                    [*keep, "n_chars", "n_pieces", "ids", "decoded", "exact"],
                )
        c.rest()

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_chars long, n_pieces long, ids array<int>, decoded string, exact boolean"])
    return df.select(*keep, df[text].alias("_text")).transform(mapped, run, ddl)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


QUERIES = {"op6_piece_codec": op6_piece_codec}
ORACLE_SQL: dict[str, str] = {}
