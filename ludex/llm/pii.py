r"""Personal data: base patterns, and candidates chosen by boosted trees.

Column expressions only: no Python code runs on the executors.

Base spans (leftmost, non-overlapping per kind, failing matches dropped):
email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to
15 digits).  They always stay.  The patterns are written with possessive
quantifiers and may only start where a run starts or the last match ended, which
gives the same matches in linear time and without recursion on long runs.

Candidates: high-recall generators per kind propose further, overlapping spans
(other separators, spelled-out "(at)", wrong check digits, missing "+").  Each
has 0/1 features of its shape and of the text around it; none tells whether it is
written as a base span.  As these features
span a finite space, ALL candidates of the corpus are summed to (kind, feature
bits, label) counts - at most ``len(KINDS) * 2 ** len(features)`` rows - and Newton
boosting of depth-2 trees is run on these sums; no row is sampled.  The label is
whether the candidate is personal data once its format is normalised (distant
supervision by ``_genuine``): "(at)", "(dot)" and blanks in emails, any separators
of cards, commas in named IPs, and phones without "+" that are grouped as phones
or named as such, so variants count as the base spans do.  Per kind the
threshold is calibrated: the lowest score at which the candidates at or above
it are still valid to at least ``PRECISION`` and those at it to ``LEAST``.  Trees and threshold are evaluated
over the whole feature space, and the result is looked up by a candidate's
bits.  A chosen candidate is added unless it overlaps a base span or a chosen
one of an earlier kind.

Null text counts as empty; positions are code points, end exclusive; rows are
independent, so repeated or null ids and extra columns do not matter; with an
empty table nothing is learned or returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, fresh

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
LEAST = 0.5
ROUNDS = 30
RATE = 0.3
RIDGE = 1.0
CONTEXT = 24

_LOCAL = "[A-Za-z0-9._%+-]"
_BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|[(\[](?i:at)[)\]])", r"[(\[](?i:dot)[)\]]"
_GROUPED = (r"(?:(?:\+?[0-9]{1,3}[ .-]{1,2})?(?:\([0-9]{2,5}\)[ .-]{0,2}|\(?[0-9]{3}[ .-]{1,2})[0-9]{3}[ .-][0-9]{4}"
            r"|\(0[0-9]{1,4}\)[ .-]?[0-9]{3,8}(?:[ .-][0-9]{2,5})?|00[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,4})")
_LOOSE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?+{_AT} ?+[A-Za-z0-9-]++(?:(?: ?+{_DOT} ?+|\.| \. )[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:[.,][0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[ .-]?+[0-9]){12,18}+(?![0-9])",
    "phone": rf"(?<![0-9A-Za-z+(])(?:{_GROUPED}(?![0-9A-Za-z])|[+(]?+[0-9](?:[ ().-]{{0,2}}+[0-9]){{6,14}}+(?![0-9A-Za-z]))",
}
_GATE = {"email": r"@|[(\[](?i:at)[)\]]", "ip": r"[0-9][.,][0-9]", "card": "[0-9]", "phone": "[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

_CALLED = r"(?i)(?:tel|phone|call|fax|mobile|cell|sms|whatsapp)[a-z]*(?: (?:me|us|at|on|is|no|number|nr))*[ .:=#-]*$"
_HOSTED = r"(?i)(?:\bip|host|addr|server)[a-z]*[ .:=-]*$"

# (name, what it reads: match, text before, text after; pattern)
FEATURES = (
    ("left_edge", "before", r"(?:^|[^A-Za-z0-9])$"),
    ("right_edge", "after", r"^(?:$|[^A-Za-z0-9])"),
    ("quoted", "before", r"[=\"'#/]\s*$"),
    ("full", "match", rf"{_AT} ?(?:[A-Za-z0-9-]+(?: ?{_DOT} ?|\.| \. ))+[A-Za-z]{{2,}}$|^(?:[0-9]{{4}}[ .-]?){{4}}$|^\+?[0-9]{{1,3}} ?\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}|^{_GROUPED}$|^(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$"),
    ("grouped", "match", rf"^(?:{_GROUPED})$"),
    ("many_digits", "match", r"(?:[0-9][^0-9]*){13,}"),
    ("named", "before", r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|credit|ip|host|addr)[a-z]*[ .:=-]*$"),
    ("called", "before", _CALLED),
)


def _spans(text: Column, pattern: str) -> Column:
    """Matches as structs ``start, match, before, after``: the pieces between the matches give the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.struct(found.alias("m"), between.alias("p"))
    empty = F.array().cast("array<struct<start:int,match:string,before:string,after:string>>")

    def place(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, k: Column) -> Column:
            m, left, right = both["m"][k], both["p"][k], both["p"][k + 1]
            at = acc["at"] + F.length(left)
            row = F.struct(at.alias("start"), m.alias("match"), F.right(left, F.lit(CONTEXT)).alias("before"),
                           F.left(right, F.lit(1)).alias("after"))
            return F.struct((at + F.length(m)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

        ks = F.when(F.size(both["m"]) > 0, F.sequence(F.lit(0), F.size(both["m"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(ks, start, step, lambda acc: acc["out"])

    return F.transform(F.array(parts), place)[0]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn (digits doubled from the second last on)."""
    ks = F.sequence(F.lit(0), F.length(digits) - 1)
    rev = F.reverse(digits)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(rev, k + 1, F.lit(1)).cast("int") * (k % 2 + 1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(F.length(digits).between(13, 19), F.aggregate(ks, F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, match: Column) -> Column:
    """Whether a string is a whole base span."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return match.rlike(f"^(?:{_BASE[kind]})$") & _luhn(_digits(match))
    if kind == "phone":
        return match.rlike(f"^(?:{_BASE[kind]})$") & F.length(_digits(match)).between(9, 15)
    return match.rlike(f"^(?:{_BASE[kind]})$")


def _genuine(kind: str, s: Column) -> Column:
    """Label of a candidate: personal data after normalising its format, by validators and the text before it."""
    match, digits = s["match"], _digits(s["match"])
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, _AT, "@"), _DOT, "."), " ", "")
        return _valid(kind, plain) & plain.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "ip":
        return _valid(kind, match) | _valid(kind, F.translate(match, ",", ".")) & s["before"].rlike(_HOSTED)
    if kind == "card":
        return _luhn(digits)
    called, n = s["before"].rlike(_CALLED), F.length(digits)
    return (n.between(9, 15) & (match.startswith("+") | match.rlike(f"^{_GROUPED}$") | called)
            | n.between(7, 8) & called & match.rlike("[0-9][ ().-]+[0-9]"))


_NONE = "array<struct<kind:int,start:int,end:int,bits:int>>"


def _cut(kind: int, spans: Column, bits: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 (s["start"] + F.length(s["match"])).alias("end"),
                                                 (_bits(s) if bits else F.lit(0)).alias("bits")))


def _bits(s: Column) -> Column:
    out = F.lit(0)
    for k, (_, part, pattern) in enumerate(FEATURES):
        out = out + F.when(s[part].rlike(pattern), 1 << k).otherwise(0)
    return out


def _gated(text: Column, kind: str, make) -> Column:
    return F.when(text.rlike(_GATE[kind]), make).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> Column:
    """All base spans, by kind then start."""
    def valid(kind: str) -> Column:
        return F.filter(_spans(text, _BASE[kind]), lambda s: _valid(kind, s["match"]))

    return F.concat(*(_gated(text, kind, _cut(k, valid(kind), False)) for k, kind in enumerate(KINDS)))


@dataclass
class Boosted:
    """Trees ``(kind or -1, bit, bit if set, bit if clear, four leaves)`` on the feature bits, thresholds per kind."""
    prior: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple[int, int, int, tuple[float, ...]]]] = field(default_factory=dict)
    threshold: dict[int, float] = field(default_factory=dict)

    def score(self, kind: int, bits: int) -> float:
        z = self.prior[kind]
        for a, b, c, leaf in self.trees[kind]:
            on = bits >> a & 1
            z += leaf[2 * on + (bits >> (b if on else c) & 1)]
        return z

    def chosen(self, bits: Column, kind: int) -> Column:
        """The trees and the threshold over the whole feature space: one flag per cell, looked up."""
        flags = "".join("1" if self.score(kind, b) >= self.threshold[kind] - 1e-9 else "0" for b in range(1 << len(FEATURES)))
        return F.substring(F.lit(flags), bits + 1, F.lit(1)) == "1"


def boost(cells: list[tuple[int, int, float, float]], rounds: int = ROUNDS, rate: float = RATE,
          precision: float = PRECISION) -> Boosted:
    """Newton boosting on sums ``(kind, bits, rows, rows of label 1)``; a kind without valid rows chooses nothing."""
    model, width = Boosted(), len(FEATURES)
    for kind in sorted({c[0] for c in cells}):
        own = sorted((b, n, y) for k, b, n, y in cells if k == kind)
        total, valid = sum(n for _, n, _ in own), sum(y for _, _, y in own)
        if not valid:
            continue
        z0 = math.log((valid + 0.5) / (total - valid + 0.5))
        model.prior[kind], model.trees[kind] = z0, []
        z = [z0] * len(own)
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-x)) for x in z]
            g = [y - n * q for (_, n, y), q in zip(own, p)]
            h = [n * q * (1 - q) for (_, n, _), q in zip(own, p)]

            def gain(at: list[int]) -> float:
                return sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + RIDGE)

            def split(at: list[int]) -> int:
                def value(k: int) -> float:
                    return gain([i for i in at if own[i][0] >> k & 1]) + gain([i for i in at if not own[i][0] >> k & 1])
                return max(range(width), key=lambda k: (value(k), -k))

            def leaf(at: list[int]) -> float:
                return rate * sum(g[i] for i in at) / (sum(h[i] for i in at) + RIDGE)

            a = split(list(range(len(own))))
            on, off = [i for i, c in enumerate(own) if c[0] >> a & 1], [i for i, c in enumerate(own) if not c[0] >> a & 1]
            b, c = split(on), split(off)
            model.trees[kind].append((a, b, c, (leaf([i for i in off if not own[i][0] >> c & 1]), leaf([i for i in off if own[i][0] >> c & 1]),
                                                leaf([i for i in on if not own[i][0] >> b & 1]), leaf([i for i in on if own[i][0] >> b & 1]))))
            z = [model.score(kind, bits) for bits, _, _ in own]
        n = y = n_here = y_here = 0.0
        ranked = sorted(zip(z, own), key=lambda r: -r[0])
        for k, (score, (_, rows, good)) in enumerate(ranked):
            n_here, y_here = n_here + rows, y_here + good
            if k + 1 < len(ranked) and ranked[k + 1][0] > score - 1e-9:
                continue
            n, y = n + n_here, y + y_here
            if y_here < LEAST * n_here:                             # from here on most candidates are not valid
                break
            if y >= precision * n:
                model.threshold[kind] = score
            n_here = y_here = 0.0
    return model


def fit(docs: DataFrame, text: str = "text") -> Boosted:
    """Boosted on the candidates of all rows; the driver gets their sums by kind and feature bits."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,bits:int,y:bigint>>")

    def cells_of(k: int, kind: str) -> Column:
        rows = F.transform(_spans(t, _LOOSE[kind]), lambda s: F.struct(
            F.lit(k).alias("kind"), _bits(s).alias("bits"), _genuine(kind, s).cast("long").alias("y")))
        return F.when(t.rlike(_GATE[kind]), rows).otherwise(none)

    found = F.concat(*(cells_of(k, kind) for k, kind in enumerate(KINDS)))
    cells = (docs.select(F.explode(found).alias("c")).groupBy("c.kind", "c.bits")
             .agg(F.count("*").alias("n"), F.sum("c.y").alias("y")).collect())
    return boost([(r.kind, r.bits, float(r.n), float(r.y)) for r in cells])


def chosen_spans(text: Column, model: Boosted) -> Column:
    """Candidates at or above their kind's threshold."""
    def of(k: int, kind: str) -> Column:
        return _gated(text, kind, F.filter(_cut(k, _spans(text, _LOOSE[kind]), True), lambda c: model.chosen(c["bits"], k)))

    return F.concat(F.array().cast(_NONE), *(of(k, kind) for k, kind in enumerate(KINDS) if k in model.threshold))


def detect(docs: DataFrame, text: str = "text", out_base: str = "base", out_added: str = "added",
           model: Boosted | None = None) -> DataFrame:
    """``docs`` with two span-array columns (``kind`` is an index into ``KINDS``)."""
    model = fit(docs, text) if model is None else model
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    (ch,) = fresh(docs, "chosen")
    base, some = col(out_base), col(ch)

    def clear(c: Column) -> Column:
        def meets(o: Column) -> Column:
            return (o["start"] < c["end"]) & (c["start"] < o["end"])
        return ~F.exists(base, meets) & ~F.exists(some, lambda o: meets(o) & (o["kind"] < c["kind"]))

    found = docs.withColumns({out_base: base_spans(t), ch: chosen_spans(t, model)})
    return found.withColumn(out_added, F.filter(some, clear)).drop(ch)


def listed(spans_: Column) -> Column:
    """``kind:start:end`` strings by kind, then start, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """``docs`` with every span (overlaps merged, named after the first) replaced by ``[KIND]``; null stays null."""
    b, a = fresh(docs, "base", "added")
    found = detect(docs, text, b, a, model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    order = F.array_sort(F.transform(F.concat(col(b), col(a)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    t = col(text)

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), names[s["kind"]]))
                        .otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    clean = F.when(F.size(col(b)) + F.size(col(a)) > 0, done).otherwise(t)
    return found.withColumn(text, clean).drop(b, a)
