"""Personal data by aggregation of weak labels, in DataFrame functions only.

Patterns propose candidate spans of several kinds. Labelers vote on each: checks of the format, gazetteers, words before
the span, words that speak against it, and its borders. Expectation-maximisation over the counts of vote patterns (a
table of bounded size) estimates how reliable each labeler is; a logistic classifier fitted to the resulting
probabilities decides on the kinds that no fixed rule defines. The four base kinds follow their rules alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm.base import hidden, table

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """pattern: candidates, leftmost and not overlapping (possessive where giving back cannot help, so that long runs
    neither recurse nor repeat). needs: a character that any candidate holds. valid: SQL over the span y."""

    name: str
    pattern: str
    needs: str
    valid: str
    base: bool = True


_DIGITS = "regexp_replace(y.t, '[^0-9]', '')"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]", rf"y.t rlike r'^{_PART}\.{_PART}\.{_PART}\.{_PART}$'"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]", f"length({_DIGITS}) between 13 and 19 and luhn_check({_DIGITS})"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "[+]", f"length({_DIGITS}) between 9 and 15"),
    Kind("local_phone", r"(?<![A-Za-z0-9+.(-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "[0-9][ .-][0-9]", "true", False),
    Kind("masked_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}+){1,8}+", "[(\\[]at[)\\]]", "true", False),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}", "(?:Mr|Ms|Dr|Prof|Herr|Frau|Mme|Sr)", "true", False),
)
ORDER = [k.name for k in KINDS]
ADDED = [k.name for k in KINDS if not k.base]
#: Gazetteers and cue words of the labelers. ``detect`` and ``train`` take longer lists as parameters.
SUFFIXES = (
    "com net org edu gov mil int info biz name pro app dev io ai co tv me cc ly gg online site shop store tech cloud blog news xyz "
    "ac ae ar at au be bg br by ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp ke kr lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us ve vn za"
).split()
NAMES = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen "
    "hans peter klaus wolfgang juergen dieter manfred uwe guenter bernd frank stefan andreas martin markus ursula monika petra sabine renate helga karin brigitte ingrid erika anna claudia julia katharina "
    "jean pierre michel philippe alain nicolas louis henri jacques marie nathalie isabelle sylvie catherine martine christine francoise valerie sophie camille chloe "
    "jose antonio juan manuel francisco luis javier carlos jesus miguel pedro rafael fernando pablo carmen maria josefa isabel dolores pilar teresa rosa lucia marta elena "
    "anne alexander oliver emma olivia noah liam sofia mia lucas mohammed ahmed ali fatima wei li yuki hiroshi raj priya ivan olga dmitri natasha"
).split()
CUES = {
    "email": "e-?mail|mail|contact|write|schreib|courriel|correo",
    "masked_email": "e-?mail|mail|contact|write|schreib|courriel|correo",
    "ip": "ip|address|host|server|client|from|login",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|contact|telefon|téléphone|teléfono",
    "local_phone": "phone|tel|call|mobile|cell|fax|contact|telefon|téléphone|teléfono",
    "person": "dear|from|by|signed|patient|client|name|contact|attn",
}
AGAINST = "version|release|isbn|issn|order|invoice|section|chapter|figure|table|part|model|sku|build"
LABELERS = ("format", "gazetteer", "cue", "against", "border")
NEAR = 32
BLOCK = 256
ACCEPT = 0.8


def _spans(text: str, k: Kind) -> Column:
    """Candidates of a kind as structs (s, e, t): positions come from the lengths of what lies between the matches,
    summed in blocks so that texts with very many matches stay near linear."""
    there = F.col(text).rlike(k.needs) & F.col(text).rlike(k.pattern)
    gaps = F.split(F.col(text), k.pattern, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(k.pattern), F.lit(0))
    return F.when(there, F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))))


_PLACED = f"""aggregate(
  transform(sequence(0, (size(q.z) - 2) div {BLOCK}), b -> slice(slice(q.z, 1, size(q.z) - 1), b * {BLOCK} + 1, {BLOCK})),
  named_struct('at', 0, 'out', cast(array() as array<array<struct<s:int,e:int,t:string>>>)),
  (o, block) -> named_struct(
    'at', o.at + aggregate(block, 0, (n, x) -> n + x.g + length(x.m)),
    'out', concat(o.out, array(aggregate(block, named_struct('at', o.at, 'out', cast(array() as array<struct<s:int,e:int,t:string>>)),
      (a, x) -> named_struct('at', a.at + x.g + length(x.m), 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + length(x.m), 't', x.m)))),
      a -> a.out)))),
  o -> flatten(o.out))"""
#: For spans _x in order of their starts, the largest end of those before each: summed up in blocks, as above.
_REACHED = f"""if(size(_x) > 0, aggregate(
  transform(sequence(0, (size(_x) - 1) div {BLOCK}), b -> slice(_x, cast(b * {BLOCK} + 1 as int), {BLOCK})),
  named_struct('m', -1, 'out', cast(array() as array<array<int>>)),
  (o, block) -> named_struct(
    'm', greatest(o.m, array_max(transform(block, x -> x.e))),
    'out', concat(o.out, array(aggregate(block, named_struct('m', o.m, 'out', cast(array() as array<int>)),
      (a, x) -> named_struct('m', greatest(a.m, x.e), 'out', concat(a.out, array(a.m))), a -> a.out)))),
  o -> flatten(o.out)), cast(array() as array<int>))"""


def _words(words: list[str]) -> str:
    return f"split('{' '.join(words)}', ' ')"


#: Code points of a block of text, from which pieces are cut without a walk from the text's start.
PIECE = 256


def _blocks(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(blocks: str, a: str, b: str) -> str:
    """SQL of the code points from a to b (exclusive, not beyond the end) of a text in blocks. The places are bound once: plans
    that repeat them grow out of hand."""
    places = f"named_struct('a', {a}, 'b', {b})"
    head = f"substring({blocks}[int(r.a div {PIECE})], r.a % {PIECE} + 1, r.b - r.a)"
    rest = f"array_join(slice({blocks}, int(r.a div {PIECE}) + 2, int((r.b - 1) div {PIECE} - r.a div {PIECE}) - 1), '')"
    tail = f"substring({blocks}[int((r.b - 1) div {PIECE})], 1, (r.b - 1) % {PIECE} + 1)"
    return f"transform(array({places}), r -> if(r.b <= r.a, '', if(r.a div {PIECE} = (r.b - 1) div {PIECE}, {head}, concat({head}, {rest}, {tail}))))[0]"


def _by_kind(values: dict[str, str], otherwise: str) -> str:
    return "case y.k " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {otherwise} end"


def _votes(names: list[str], suffixes: list[str]) -> str:
    """One vote of each labeler (1 for, -1 against, 0 none) on the span y: its kind k, its text t, b before and a after it,
    and whether its kind's rule holds (ok)."""
    lists = {
        "email": f"if(array_contains({_words(suffixes)}, lower(regexp_extract(y.t, '[.]([A-Za-z0-9-]+)$', 1))), 1, -1)",
        "ip": "if(y.t rlike r'^(?:0|127|255)[.]', -1, 1)",
        "card": "if(y.t rlike '^[3-6]', 1, -1)",
        "phone": "if(y.t rlike r'^[+](?:1|2[07]|3[0-4694]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])', 1, 0)",
        "local_phone": "if(y.t rlike r'^[(]?(?:[2-9]11)', -1, 0)",
        "masked_email": f"if(array_contains({_words(suffixes)}, lower(regexp_extract(y.t, '([A-Za-z0-9-]+)$', 1))), 1, -1)",
        "person": f"if(arrays_overlap({_words(names)}, split(lower(y.t), '[^a-z]+')), 1, 0)",
    }
    base = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    return ", ".join(
        (
            f"if(y.k in ({base}), if(y.ok, 1, -1), 0)",
            _by_kind(lists, "0"),
            "if(" + _by_kind({k: f"lower(y.b) rlike '(?<![a-z])(?:{cue})(?![a-z])'" for k, cue in CUES.items()}, "false") + ", 1, 0)",
            f"if(lower(y.b) rlike '(?<![a-z])(?:{AGAINST})[ #:.]*$', -1, 0)",
            "if(y.b rlike '[A-Za-z0-9]$' or y.a rlike '^[A-Za-z0-9]', -1, 1)",
        )
    )


def candidates(df: DataFrame, text: str = "text", names: list[str] = NAMES, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """df with _spans: all candidates as structs (k, s, e, ok, v): kind, code points (end exclusive), whether the kind's
    own rule holds, votes. Spans of all kinds go through one expression, which keeps the plan small."""
    out = df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({f"_z{i}": _spans("_raw", k) for i, k in enumerate(KINDS)})
    every = ", ".join(f"named_struct('k', '{k.name}', 'z', _z{i})" for i, k in enumerate(KINDS))
    out = out.withColumn("_q", F.expr(f"filter(array({every}), q -> q.z is not null)"))
    out = out.withColumns({"_b": F.when(F.size("_q") > 0, _blocks("_raw")), "_n": F.length("_raw")})
    before = f"right(concat(if(x.s < {PIECE}, '', _b[int(x.s div {PIECE}) - 1]), left(_b[int(x.s div {PIECE})], x.s % {PIECE})), {NEAR})"
    after = f"if(x.e < _n, substring(_b[int(x.e div {PIECE})], x.e % {PIECE} + 1, 1), '')"
    valid = _by_kind({k.name: k.valid for k in KINDS if k.valid != "true"}, "true")
    out = out.withColumn("_y", F.expr(f"flatten(transform(_q, q -> transform({_PLACED}, x -> named_struct('k', q.k, 's', x.s, 'e', x.e, 't', x.t, 'b', {before}, 'a', {after}))))"))
    out = out.withColumn("_y", F.expr(f"transform(_y, y -> named_struct('k', y.k, 's', y.s, 'e', y.e, 't', y.t, 'b', y.b, 'a', y.a, 'ok', {valid}))"))
    out = out.withColumn("_spans", F.expr(f"transform(_y, y -> named_struct('k', y.k, 's', y.s, 'e', y.e, 'ok', y.ok, 'v', array({_votes(names, suffixes)})))"))
    return out.drop("_raw", "_q", "_b", "_n", "_y", *(f"_z{i}" for i in range(len(KINDS))))


@dataclass(frozen=True)
class Classifier:
    """Logistic weights: a bias for each kind and a weight for each labeler's vote for and against."""

    bias: dict[str, float]
    votes: tuple[tuple[float, float], ...]
    reliability: dict[str, tuple[float, float]]

    def score(self, kind: str, votes: tuple[int, ...]) -> float:
        s = self.bias.get(kind, 0.0) + sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(votes, self.votes, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))

    def accepts(self, kind: str, threshold: float) -> str:
        """SQL over a span x: whether an added kind is accepted."""
        sums = " + ".join(f"if(x.v[{j}] > 0, {w[0]!r}D, if(x.v[{j}] < 0, {w[1]!r}D, 0D))" for j, w in enumerate(self.votes))
        return f"({self.bias.get(kind, 0.0)!r}D + {sums} >= {math.log(threshold / (1 - threshold))!r}D)"


def learn(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> Classifier:
    """Reliabilities by expectation-maximisation over two classes, then the classifier by gradient steps.

    counts: occurrences of each (kind, votes); there are at most 3^labelers a kind, however large the corpus."""
    n = len(LABELERS)
    belief = {key: min(0.95, max(0.05, 0.5 + 0.2 * sum(key[1]))) for key in counts}
    like: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds if counts else 0):
        mass = [sum(c * (belief[k] if z else 1 - belief[k]) for k, c in counts.items()) for z in (0, 1)]
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        like = []
        for j in range(n):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for (kind, votes), c in counts.items():
                p = belief[kind, votes]
                seen[votes[j]][1] += c * p
                seen[votes[j]][0] += c * (1 - p)
            total = [sum(s[z] for s in seen.values()) for z in (0, 1)]
            like.append({v: (s[0] / total[0], s[1] / total[1]) for v, s in seen.items()})
        for key in belief:
            logit = math.log(prior / (1 - prior)) + sum(math.log(like[j][v][1] / like[j][v][0]) for j, v in enumerate(key[1]) if v)
            belief[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    reliability = {name: (round(like[j][1][1], 6), round(like[j][-1][0], 6)) if like else (0.5, 0.5) for j, name in enumerate(LABELERS)}
    bias, weights = dict.fromkeys(ORDER, -2.0), [[1.0, -1.0] for _ in range(n)]
    total = sum(counts.values()) or 1
    for _ in range(400 if counts else 0):
        step_b, step_w = dict.fromkeys(ORDER, 0.0), [[0.0, 0.0] for _ in range(n)]
        model = Classifier(bias, tuple(map(tuple, weights)), {})
        for (kind, votes), c in counts.items():
            off = (belief[kind, votes] - model.score(kind, votes)) * c / total
            step_b[kind] += off
            for j, v in enumerate(votes):
                if v:
                    step_w[j][v < 0] += off
        bias = {k: b + 2.0 * step_b[k] for k, b in bias.items()}
        weights = [[a + 2.0 * x, b + 2.0 * y] for (a, b), (x, y) in zip(weights, step_w, strict=True)]
    rounded = lambda x: round(x, 9)
    return Classifier({k: rounded(b) for k, b in bias.items()}, tuple((rounded(a), rounded(b)) for a, b in weights), reliability)


def train(df: DataFrame, text: str = "text", names: list[str] = NAMES, suffixes: list[str] = SUFFIXES) -> Classifier:
    """The classifier from the votes on all candidates of df; from none, weights that trust every labeler."""
    each = candidates(df.select(text), text, names, suffixes).select(F.explode_outer("_spans").alias("x")).where("x is not null")
    rows = each.groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v")).count().collect()  # at most kinds * 3^labelers rows
    return learn({(r.k, tuple(r.v)): r["count"] for r in rows})


def detect(df: DataFrame, text: str = "text", model: Classifier | None = None, threshold: float = ACCEPT, names: list[str] = NAMES, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """df with pii: all spans found, as structs (kind, s, e) with code points, end exclusive, by kind in the order of
    KINDS, then by start.

    The base kinds hold every match of their rules; the added kinds those whose probability reaches the threshold.
    Spans of different kinds may overlap. Null and empty texts have none; an empty table gives an empty one; repeated rows
    are decided alike. A column named pii is replaced, all others pass unchanged. Rows never move; what is gathered is one
    count for each pattern of votes. names and suffixes (lower case, a-z) are the gazetteers of given names and of the last
    labels of addresses."""
    df, own = hidden(df.drop("pii"))
    text = {c: new for new, c in own.items()}.get(text, text)
    if model is None:
        model = train(df, text, names, suffixes)
    keep = " or ".join(["x.ok and x.k in (" + ", ".join(f"'{k.name}'" for k in KINDS if k.base) + ")", *(f"x.k = '{k}' and {model.accepts(k, threshold)}" for k in ADDED)])
    out = candidates(df, text, names, suffixes)
    return out.withColumn("pii", F.expr(f"transform(filter(_spans, x -> {keep}), x -> named_struct('kind', x.k, 's', x.s, 'e', x.e))")).drop("_spans").withColumnsRenamed(own)


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """df with every span of ``pii`` replaced by its kind in brackets (that of the first of several which overlap). Null
    texts and texts without spans stay as they are, and so do all other columns. The work grows in proportion with the
    text and the spans."""
    df, own = hidden(df)
    text, pii = ({c: new for new, c in own.items()}.get(x, x) for x in (text, pii))
    out = df.withColumn("_x", F.expr(f"array_sort(transform({pii}, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    out = out.withColumn("_to", F.expr(_REACHED))  # how far the spans before each reach
    out = out.withColumn("_i", F.expr("filter(if(size(_x) > 0, sequence(0, size(_x) - 1), cast(array() as array<int>)), i -> _x[i].s >= _to[i])"))
    last = "array_max(transform(_x, x -> x.e))"
    out = out.withColumn("_m", F.expr(f"transform(_i, (i, j) -> named_struct('s', _x[i].s, 'e', if(j + 1 < size(_i), _to[get(_i, j + 1)], {last}), 'kind', _x[i].kind))"))
    out = out.withColumns({"_b": F.when(F.size("_m") > 0, _blocks(text)), "_n": F.length(text)})
    pieces = f"transform(_m, (x, j) -> concat({_cut('_b', 'if(j > 0, get(_m, j - 1).e, 0)', 'x.s')}, '[', upper(x.kind), ']'))"
    whole = f"concat(array_join({pieces}, ''), {_cut('_b', 'array_max(transform(_m, x -> x.e))', '_n')})"
    return out.withColumn(text, F.when(F.size("_m") > 0, F.expr(whole)).otherwise(F.col(text))).drop("_x", "_to", "_i", "_m", "_b", "_n").withColumnsRenamed(own)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, base), F.sha2(line(F.filter("pii", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLE_SQL: dict[str, str] = {}
