"""Secret scans with DataFrame functions only: fixed patterns plus a randomness test battery.

Fixed patterns give the base spans. Besides, every run of at least ``SHORTEST`` key characters is a candidate. Its encoding is
inferred from the characters it uses, and three tests ask whether it is uniform random characters of that encoding: chi-squared
over the alphabet, runs over its halves, lag-1 serial correlation. Their joint p-value (three times the least) goes through two
false-discovery steps (Benjamini-Hochberg, on histograms over all distinct candidates):

- candidates whose joint p-value the step rejects are structured, so that at most ``RATE`` of the rejected are random after all;
- the others are secrets if the step over the directed form of the alphabet test accepts them: the likelihood of the run as
  uniform characters of its encoding against that as words, whose letters come at the frequencies of text and which seldom
  change between small letters, capitals, digits and others. Words reach a ratio r with a chance of at most 1/r, so that at
  most ``RATE`` of what is reported are words. The ratio grows with length: longer runs need less evidence a character.

Digits have no frequencies of text, so for them the first step decides.

Offsets count code points. Defined cases: a null text counts as empty; no secret gives empty spans; matches that fail a length
rule are consumed but dropped; a random span that touches a base span is part of it and not listed again; repeated rows each
get their result but count once in the false-discovery steps; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Fixed values of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE, SHORTEST = 6, 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: False-discovery rate of either step, and how often text changes its character class.
RATE, TEXT_CHANGES = 0.01, 0.2
MASK = "[SECRET]"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide: pattern of the whole run, alphabet.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS), (r"^[0-9a-f]+$", _DIGITS + "abcdef"), (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"), (r"^[a-z]+$", _LOWER), (r"^[A-Z]+$", _UPPER), (r"^[A-Z2-7]+=*$", _UPPER + "234567"), (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER), (r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER), (r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
_WIDEST = _UPPER + _LOWER + _DIGITS + "+/"
#: Letters a to z in a million letters of English text. A tenth of the weight is even, for other languages.
LETTERS = (81670, 14920, 27820, 42530, 127020, 22280, 20150, 60940, 69660, 1530, 7720, 40250, 24060, 67490, 75070, 19290, 950, 59870, 63270, 90560, 27580, 9780, 23600, 1500, 19740, 740)
_EVEN = 0.1
#: Minus log of the chance of each character within its class: digits, small, capitals, others.
_KNOWN = _DIGITS + _LOWER + _UPPER + "+/_-="
_LETTER_COSTS = [-log((1 - _EVEN) * n / sum(LETTERS) + _EVEN / 26) for n in LETTERS]
_COSTS = [log(10)] * 10 + _LETTER_COSTS * 2 + [log(5)] * 5
_CLASSES = 4
_SPAN = "struct<start:int,ord:int,stop:int,token:string>"


def _spans(text: Column, pattern: str, order: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans, by the lengths of the pieces between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    parts = [pieces.alias("piece"), matches.alias("match")] + ([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value")] if keep else [])

    def step(state, x):
        start = (state["at"] + F.length(x["piece"])).cast("int")
        stop = (start + F.length(x["match"])).cast("int")
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), x["match"].alias("token")))
        more = F.when(keep(x["value"]), F.concat(state["out"], span)).otherwise(state["out"]) if keep else F.concat(state["out"], span)
        return F.struct(stop.alias("at"), more.alias("out"))

    whole = F.filter(F.arrays_zip(*parts), lambda x: x["match"].isNotNull())
    none = F.array().cast(f"array<{_SPAN}>")
    found = F.aggregate(whole, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    kinds = (_spans(text, ASSIGN, 0, lambda v: F.length(v) >= LEAST_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    return F.array_sort(F.concat(*kinds))


def _two_sided(z: Column) -> Column:
    """Normal tail beyond the absolute value, both sides (error below 2e-7)."""
    x = F.least(F.abs(z), F.lit(30.0)) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _total(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + f(x).cast("double"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(array: Column) -> Column:
    return F.arrays_zip(F.slice(array, F.lit(1), F.size(array) - 1).alias("a"), F.slice(array, F.lit(2), F.size(array) - 1).alias("b"))


def _battery(token: Column) -> Column:
    """(structure, unlike, digits) of a candidate: minus log of the joint p-value of uniform characters; minus log of the chance that words look so; whether it is digits only."""
    core = F.rtrim(token, F.lit("="))
    alphabet = reduce(lambda other, e: F.when(token.rlike(e[0]), F.lit(e[1])).otherwise(other), reversed(ENCODINGS), F.lit(_WIDEST))
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)

    def counted(x):
        return F.struct(x["core"].alias("core"), F.length(x["core"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), letters(x["alphabet"]).alias("alphabet"), F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c).cast("double")).alias("place"), F.transform(x["chars"], kind).alias("kind"), F.transform(x["chars"], lambda c: F.instr(F.lit(_KNOWN), c)).alias("known"))

    def summed(x):
        squares = _total(x["alphabet"], lambda c: F.pow(F.length(x["core"]) - F.length(F.replace(x["core"], c, F.lit(""))), F.lit(2.0)))
        halves = F.transform(x["place"], lambda v: (v > x["k"] / 2).cast("int"))
        return F.struct(
            x["n"].alias("n"), x["k"].alias("k"), x["place"].alias("place"), (x["k"] / x["n"] * squares - x["n"]).alias("chi"), (1 + _total(_pairs(halves), lambda v: v["a"] != v["b"])).alias("runs"),
            _total(halves, lambda v: v).alias("high"), (_total(x["place"], lambda v: v) / x["n"]).alias("mean"), _total(_pairs(x["kind"]), lambda v: v["a"] != v["b"]).alias("changes"),
            _total(x["known"], lambda v: F.element_at(F.lit(_COSTS), v)).alias("within"),
        )

    def judged(x):
        n, free, mean, q = x["n"], x["k"] - 1, x["mean"], TEXT_CHANGES
        z_chi = F.greatest(F.lit(0.0), (F.pow(x["chi"] / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        cross = 2 * x["high"] * (n - x["high"])
        z_runs = F.coalesce((x["runs"] - cross / n - 1) / F.nullif(F.sqrt(cross * F.greatest(cross - n, F.lit(0.0)) / (n * n * (n - 1))), F.lit(0.0)), F.lit(99.0))
        spread = _total(x["place"], lambda v: (v - mean) * (v - mean))
        z_serial = F.coalesce(_total(_pairs(x["place"]), lambda v: (v["a"] - mean) * (v["b"] - mean)) / F.nullif(spread, F.lit(0.0)) * F.sqrt(n), F.lit(99.0))
        as_text = log(_CLASSES) + x["within"] - x["changes"] * log(q / (_CLASSES - 1)) - (n - 1 - x["changes"]) * log(1 - q)
        unlike = F.greatest(F.lit(0.0), as_text - n * F.log(x["k"]) - log(len(ENCODINGS) + 1))  # one of the encodings fits best
        tails = _let(F.array(z_chi, z_runs, z_serial), lambda z: F.least(_two_sided(z[0]) / 2, _two_sided(z[1]), _two_sided(z[2])))
        joint = F.greatest(F.lit(0.0), -F.log(F.greatest(3 * tails, F.lit(1e-250))))
        return F.struct(joint.alias("structure"), unlike.alias("unlike"), (x["k"] == len(_DIGITS)).alias("digits"))

    start = F.struct(core.alias("core"), alphabet.alias("alphabet"), letters(core).alias("chars"))
    return _let(start, lambda x: _let(counted(x), lambda y: _let(summed(y), judged)))


def scanned(documents: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``base`` (base spans) and ``tested`` (candidates that touch no base span, with their tests)."""
    text = text_or_empty()
    rows = documents.select(*columns, base_spans(text).alias("base"), _spans(text, CANDIDATE, 3).alias("_free"))
    touches = lambda c: lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])
    free = F.filter("_free", lambda c: (F.length(F.rtrim(c["token"], F.lit("="))) >= SHORTEST) & ~F.exists("base", touches(c)))
    tested = F.transform(free, lambda c: F.struct(c.alias("span"), _battery(c["token"]).alias("test")))
    return rows.select(*columns, "base", tested.alias("tested"))


#: Steps of the histograms a unit of minus log p, and their last bin.
STEPS, LAST = 4, 400


def _accepted(held: dict[int, int]) -> float:
    """The least minus log p that the step-up rule accepts, from counts by bin; bins count as their weakest member, so the rate is kept."""
    every, above, best = sum(held.values()), 0, float("inf")
    for b in sorted(held, reverse=True):
        above += held[b]
        if b > 0 and exp(-b / STEPS) * every <= RATE * above:
            best = b / STEPS
    return best


def cut_offs(tested: DataFrame) -> tuple[float, float]:
    """From which ``structure`` a candidate isn't random, and from which ``unlike`` a random one is no word."""
    runs = tested.select(F.explode("tested").alias("t")).select("t.span.token", "t.test").distinct()
    bin_ = lambda name: F.least(F.floor(F.col(f"test.{name}") * STEPS), F.lit(LAST)).cast("int")
    counts = runs.groupBy(bin_("structure").alias("s"), bin_("unlike").alias("u"), "test.digits").count().collect()  # at most (LAST + 1) squared rows a kind
    structure, unlike = {}, {}
    for s, u, digits, n in counts:
        structure[s] = structure.get(s, 0) + n
        if not digits:
            unlike[u] = unlike.get(u, 0) + n
    return _accepted(structure), _accepted(unlike)


def all_spans(cuts: tuple[float, float]) -> Column:
    """Base spans and accepted random ones by start, then kind."""
    random = lambda t: (F.floor(t["structure"] * STEPS) / STEPS < F.lit(cuts[0])) & (t["digits"] | (t["unlike"] >= F.lit(cuts[1])))
    chosen = F.filter("tested", lambda t: random(t["test"]))
    return F.array_sort(F.concat("base", F.transform(chosen, lambda t: t["span"])))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, ("assign", "access", "hex", "random"))), s["ord"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` for every document."""
    rows = materialize(scanned(documents, "doc_id"), "secrets")  # spans only, no texts
    count = lambda order: F.size(F.filter("base", lambda s: s["ord"] == order)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(all_spans(cut_offs(rows))).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by ``MASK`` and ``n_chars`` brought in line where it is there; columns and rows stay.

    Texts are scanned once; rows and their spans are written before the cut-offs are known.
    """
    columns = documents.columns
    found = materialize(scanned(documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "text"), "__row"), "scanned")
    rows = found.select("__row", all_spans(cut_offs(found)).alias("__spans"))
    text = F.col("__row.text")

    def step(state, s):
        fresh = s["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate("__spans", begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.size("__spans") > 0, folded).otherwise(text)
    out = rows.select("__row.*", clean.alias("__clean"), (F.size("__spans") > 0).alias("__hit"))
    fresh = {"text": F.col("__clean"), "n_chars": F.when(F.col("__hit"), F.length("__clean").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[(fresh[c].alias(c) if c in fresh else F.col(f"`{c}`")) for c in columns])
