"""Secret scans in DataFrame operations only.

Three patterns give the base spans. Beside them every long token that mixes letters and digits goes through
a battery of randomness tests in the smallest encoding that holds it (hex, base 32, base 36, base 62, base
64): chi-squared uniformity over the encoding's alphabet, runs above and below its middle, and lag-one serial
correlation. A token stays a candidate unless randomness is rejected. Whether candidates are secrets is then
settled by controlling false discoveries: the p-value of a token is the chance that ordinary text of its
length, confined to its encoding, is as free of repeats, where two letters agree as often as in written
language (in hex, as often as its letters a to f and the token's own share of digits). In the encodings of one
case it is joined by Fisher's rule with the chance that text turns as often from letters to digits or back.
Tokens are classed by length (doubling classes) and each class is cut by the step-up rule at rate ``fdr``, since
short tokens prove less.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.frames import settled

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)

#: Cheap necessary conditions, so that most texts are never cut up.
NEEDS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}

#: A whole run of 20 symbols or more with a digit among them; mid-run starts fail at once, so runs cost their length.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
TOKEN_NEEDS = TOKEN

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

#: Encodings from the smallest: pattern, alphabet in which a symbol's place is its value, whether case is folded.
ENCODINGS = (
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", True),
    (r"^[A-Z2-7]+$", _UPPER + "234567", False),
    (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, True),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, False),
    (r"", _UPPER + _LOWER + _DIGITS + "+/", False),
)

#: Chances that two and three letters of written language agree.
TEXT_PAIR, TEXT_TRIPLE = 0.065, 0.0055

#: The same among the letters a to f of written language alone, and among digits.
HEX_PAIR, HEX_TRIPLE, DIGIT_PAIR, DIGIT_TRIPLE = 0.261, 0.0855, 0.1, 0.01

#: Chance that text with digits in it turns from letters to digits, or back, at a symbol: one number in 20 symbols.
TEXT_TURN = 0.1

#: The first encodings are of one case and hold no signs.
PLAIN_ENCODINGS = 3

#: p-values are counted in classes of a quarter of a power of ten, down to 10**-75.
P_STEPS, P_CLASSES = 4, 300

#: Places are summed up in blocks of this many matches.
BLOCK = 128

_SPAN = "array<struct<start: int, end: int, kind: int, token: string>>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(sizes: Column) -> Column:
    """Sum of the sizes before each place. In blocks, since a fold that gathers a list copies it at every step."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    none = F.array().cast("array<array<int>>")
    cut = F.when(F.size(sizes) == 0, none).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    )

    def joined(e: Column) -> Column:
        first = lambda block, b: F.transform(F.array(total(F.slice(e["sums"], 1, b))), lambda base: F.transform(block, lambda _, i: base + total(F.slice(block, 1, i))))
        return F.flatten(F.flatten(F.transform(e["blocks"], first)))

    return _let(cut, lambda blocks: _let(F.struct(blocks.alias("blocks"), F.transform(blocks, total).alias("sums")), joined))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points; those with a shorter group are dropped."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), held.alias("held"))  # the last gap has no hit
    parts = F.transform(F.filter(zipped, lambda p: p["hit"].isNotNull()), lambda p: F.struct(
        F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("size"), p["hit"].alias("hit"), F.char_length(p["held"]).alias("held")
    ))

    def placed(e: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            start = F.get(e["before"], i) + p["gap"]
            return F.struct(start.alias("start"), (start + p["size"]).alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("token"), p["held"].alias("held"))

        long = F.filter(F.transform(e["parts"], span), lambda s: s["held"] >= least)
        return F.transform(long, lambda s: F.struct(s["start"], s["end"], s["kind"], s["token"])).cast(_SPAN)

    return _let(parts, lambda own: _let(F.struct(own.alias("parts"), _before(F.transform(own, lambda p: p["gap"] + p["size"])).alias("before")), placed))


def _normal_tail(z: Column) -> Column:
    """Chance of a standard normal above z, by the five-term rational approximation (error below 1e-7)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def _turns_tail(n: Column, k: Column) -> Column:
    """Bound on the chance of k turns or more at n places: the binomial term at k, and a geometric series for those above."""
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log((n - i + 1.0) / i))
    ratio = (n - k) * TEXT_TURN / ((k + 1.0) * (1.0 - TEXT_TURN))
    term = F.exp(terms + k * math.log(TEXT_TURN) + (n - k) * math.log(1.0 - TEXT_TURN))
    return F.when(k > n * TEXT_TURN + 1.0, F.least(F.lit(1.0), term / (1.0 - ratio))).otherwise(F.lit(1.0))


def _both(p: Column, q: Column) -> Column:
    """Fisher's joint chance of two independent ones."""
    product = F.greatest(p * q, F.lit(1e-300))
    return product * (1.0 - F.log(product))


def _battery(token: Column) -> Column:
    """(n, p_random, p_text, p_own) of a token of two symbols or more: p_text for free text, p_own for text confined to the encoding."""
    alphabet = own = code = None
    for k, (pattern, letters, fold) in reversed(list(enumerate(ENCODINGS))):
        plain = F.lower(token) if fold else F.translate(token, "-_", "+/")
        fits = token.rlike(pattern)
        alphabet = F.lit(letters) if alphabet is None else F.when(fits, F.lit(letters)).otherwise(alphabet)
        own = plain if own is None else F.when(fits, plain).otherwise(own)
        code = F.lit(k) if code is None else F.when(fits, F.lit(k)).otherwise(code)
    runs_of = lambda pattern: F.size(F.regexp_extract_all(token, F.lit(pattern), F.lit(0)))
    digits = F.char_length(F.regexp_replace(token, "[^0-9]+", ""))
    turned = F.greatest(F.lit(0), runs_of("[0-9]+") + runs_of("[^0-9]+") - 1)
    start = F.struct(own.alias("own"), alphabet.alias("alphabet"), code.alias("code"), digits.alias("digits"), turned.alias("turned"))
    symbols = F.transform(F.array(start), lambda e: F.struct(
        F.char_length(e["alphabet"]).cast("double").alias("m"), e["code"].alias("code"), e["digits"].alias("digits"), e["turned"].alias("turned"),
        F.transform(F.filter(F.split(e["own"], ""), lambda c: c != ""), lambda c: F.position(c, e["alphabet"]) - 1).alias("v"),
        # occurrences of each symbol of the alphabet, by what is left without it
        F.transform(F.filter(F.split(e["alphabet"], ""), lambda c: c != ""), lambda c: F.char_length(e["own"]) - F.char_length(F.replace(e["own"], c, F.lit("")))).alias("each"),
    ))

    def sums(e: Column) -> Column:
        v, m = e["v"], e["m"]
        n = F.size(v).cast("double")
        zero = F.lit(0.0)
        same = F.aggregate(e["each"], zero, lambda a, x: a + x.cast("double") * x.cast("double"))
        return F.struct(e["code"].alias("code"), e["digits"].alias("digits"), e["turned"].alias("turned"), v.alias("v"), m.alias("m"), n.alias("n"), same.alias("same"), (F.aggregate(v, zero, lambda a, x: a + x) / n).alias("mean"))

    def counts(e: Column) -> Column:
        v, half, mean = e["v"], e["m"] / 2.0, e["mean"]
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v) - 1).alias("b"))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))) + 1.0
        high = F.size(F.filter(v, lambda x: x >= half)).cast("double")
        lag = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.struct(e["code"].alias("code"), e["digits"].alias("digits"), e["turned"].alias("turned"), e["m"].alias("m"), e["n"].alias("n"), e["same"].alias("same"), turns.alias("turns"), high.alias("high"), lag.alias("lag"), spread.alias("spread"))

    def chances(e: Column) -> Column:
        m, n = e["m"], e["n"]
        uneven = (m / n * e["same"] - n - (m - 1.0)) / F.sqrt(2.0 * (m - 1.0) * (n - 1.0) / n)
        mean = 1.0 + 2.0 * e["high"] * (n - e["high"]) / n
        runs = (e["turns"] - mean) / F.sqrt((mean - 1.0) * (mean - 2.0) / (n - 1.0))
        serial = (e["lag"] / e["spread"] + 1.0 / n) * F.sqrt(n)
        least = F.least(_normal_tail(uneven), 2.0 * _normal_tail(F.abs(runs)), 2.0 * _normal_tail(F.abs(serial)))
        varied = (mean > 2.0) & (e["spread"] > 0.0)
        agree = (e["same"] - n) / (n * (n - 1.0))

        def freedom(pair, triple) -> Column:
            deviation = F.sqrt((2.0 * (pair - pair * pair) + 4.0 * (n - 2.0) * (triple - pair * pair)) / (n * (n - 1.0)))
            return _normal_tail((pair - agree) / deviation)

        text = freedom(TEXT_PAIR, TEXT_TRIPLE)
        d = e["digits"] / n
        hexed = freedom(
            (1.0 - d) * (1.0 - d) * HEX_PAIR + d * d * DIGIT_PAIR, (1.0 - d) * (1.0 - d) * (1.0 - d) * HEX_TRIPLE + d * d * d * DIGIT_TRIPLE
        )
        own = F.when(e["code"] < PLAIN_ENCODINGS, _both(F.when(e["code"] == 0, hexed).otherwise(text), _turns_tail(n - 1.0, e["turned"]))).otherwise(text)
        random = F.when(varied, F.least(F.lit(1.0), 3.0 * least)).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), random.alias("p_random"), text.alias("p_text"), own.alias("p_own"))

    return F.get(F.transform(F.transform(F.transform(symbols, sums), counts), chances), F.lit(0))


def _classed(token: Column) -> Column:
    """The token's place with its length class, its class of p-value, and whether the battery lets it pass."""
    test = _battery(token["token"])
    one = F.transform(F.array(test), lambda t: F.struct(
        token["start"].alias("start"), token["end"].alias("end"),
        F.floor(F.log2(t["n"] / 20.0)).cast("int").alias("size"),
        F.least(F.lit(P_CLASSES), F.floor(-F.log10(F.greatest(t["p_own"], F.lit(1e-80))) * P_STEPS)).cast("int").alias("step"),
        t["p_random"].alias("p_random"),
    ))
    return F.get(one, F.lit(0))


def scanned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, tokens): base spans and tested tokens of each document, in one pass over the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("id"), body.alias("body"))
    none = F.array().cast(_SPAN)
    found = [F.when(F.col("body").rlike(NEEDS[k]), spans_of(F.col("body"), p, i, g, least)).otherwise(none) for i, (k, p, g, least) in enumerate(BASE)]
    tokens = F.when(F.col("body").rlike(TOKEN_NEEDS), spans_of(F.col("body"), TOKEN, len(BASE))).otherwise(none)
    mixed = F.filter(tokens, lambda t: t["token"].rlike("[A-Za-z]"))
    return rows.select("id", F.concat(*found).alias("base"), mixed.alias("mixed")).select(
        "id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
        F.transform("mixed", _classed).alias("tokens"),
    )


def cuts(tests: DataFrame, fdr: float) -> DataFrame:
    """One row: for each length class the least step of p-value that the step-up rule accepts.

    Works on counts per (class, step), a few thousand rows at any size of the corpus.
    """
    each = tests.select(F.explode("tokens").alias("t")).groupBy("t.size", "t.step").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("size")
    ranked = each.select("size", "step", F.sum("n").over(by_size.orderBy(F.desc("step"))).alias("reached"), F.sum("n").over(by_size).alias("all"))
    chance = F.pow(F.lit(10.0), -F.col("step") / F.lit(float(P_STEPS)))
    passed = ranked.where(chance <= fdr * F.col("reached") / F.col("all")).groupBy("size").agg(F.min("step").alias("step"))
    return passed.agg(F.map_from_entries(F.collect_list(F.struct("size", "step"))).alias("cuts"))


def find_secrets(documents: DataFrame, fdr: float = 0.01, alpha: float = 0.001, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): secrets of every document as (start, kind, end), in code points, by start and then kind.

    Kinds are 0 assign, 1 access, 2 hex and 3 random; a random token that overlaps a base span is left out.
    ``alpha``: the battery rejects randomness below it; ``fdr``: rate of false discoveries within a length
    class. Null and empty texts have no spans; every row gives one row, also for null or equal ids; other
    columns do not matter; an empty table gives an empty result.
    """
    tests = settled(scanned(documents, doc_id, text), "secret-tests")
    both = tests.join(F.broadcast(cuts(tests, fdr)))  # one row
    accepted = F.filter("tokens", lambda t: (t["p_random"] >= alpha) & (t["step"] >= F.coalesce(F.element_at("cuts", t["size"]), F.lit(P_CLASSES + 1))))
    free = F.filter(accepted, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end")))
    return both.select("id", F.array_sort(F.concat("base", added)).alias("spans"))


def span_names(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in (*(b[0] for b in BASE), "random")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
