"""Personal data by weak supervision (operator 8), in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers; those spans always
stay. Wider patterns find candidates besides: written-out addresses, phone numbers without a country code,
account numbers, names after a title, dates, postal addresses. On every match of a fixed pattern, also those
that fail its rule and are no span, and on every candidate, three labelers vote yes, no or nothing: a strict
regular expression, a gazetteer of known parts, and cue words in the text before. Expectation-maximisation over the counts of vote patterns of all spans estimates each
labeler's reliability without labels, and its posteriors train a logistic span classifier, which decides on
the candidates. What reaches the driver is the table of counts by discrete features: at most
(4 + 6) * 3^3 * 2^3 rows, however many documents there are.

Candidates are looked for kind by kind in a text whose base spans and earlier candidates are blanked out,
so none overlaps another span. Time grows with a text's length and number of spans: positions are added up
in blocks. Cue words count within CONTEXT code points before a span, back to the span of that kind before
it; parts of addresses have the lengths that their formats allow (64 and 63 characters, 34 of an account).

Defined results. Null or empty text: no spans. Repeated rows and doc_ids: one result a row. No rows: no
rows. No spans at all, or no candidates: base spans only. Positions are code points. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds; they come after the fixed ones, and are looked for in this order.
ADDED = ("contact", "account", "number", "birth", "address", "person")

# The fixed patterns, in forms that Java's engine matches in linear time and without recursion: possessive
# loops where the next part can't begin inside them, and starts only where a leftmost match can start.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Patterns of candidates, and what makes one look promising at low cost.
_CANDIDATES = {
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9+().-])(?<![0-9+][ ])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
    "address": r"(?<![0-9])[0-9]{1,5} (?:\p{Lu}\p{Ll}+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square)(?!\p{L})|(?<!\p{L})\p{Lu}\p{Ll}+(?:straße|strasse|platz|allee) [0-9]{1,5}(?![0-9])|(?<!\p{L})(?:Calle|Avenida|Plaza) \p{Lu}\p{Ll}+,? [0-9]{1,5}(?![0-9])",
    "person": r"(?<!\p{L})(?:Mrs?\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Madame|Monsieur|Señora?) \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}+",
}
_HINTS = {
    "contact": r"(?i)[(\[{]at[)\]}]",
    "account": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[0-9]-[0-9]{2}-[0-9]",
    "number": r"[0-9]{3}[ .-][0-9]{4}",
    "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]",
    "address": r"[0-9] \p{Lu}\p{Ll}|\p{Ll},? [0-9]",
    "person": r"(?:Mrs?|Ms|Dr|Prof)\. \p{Lu}|(?:Herr|Frau|Madame|Monsieur|Señora?) \p{Lu}",
}
# What a strict reading of each kind asks for.
_STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[0-9 .-]+$",
    "contact": r"^[A-Za-z][A-Za-z0-9._+-]*+ ?.at. ?[A-Za-z0-9-]+(?: ?(?:\.|.dot.) ?[A-Za-z0-9-]+)* ?(?:\.|.dot.) ?[A-Za-z]{2,}$",
    "account": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,}|^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "number": r"^\([2-9][0-9]{2}\) [0-9]{3}-[0-9]{4}$|^[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4}$",
    "birth": r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]|^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$",
    "address": r"^[1-9][0-9]* (?:\p{Lu}\p{Ll}+ )+|^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?,? [1-9][0-9]*$",
    "person": r" \p{Lu}\p{Ll}+[ -]\p{Lu}\p{Ll}+",
}
# Known parts that speak for a span. Kinds in _OPEN are too many to list, so that an unknown part says nothing.
_GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$|gmail|yahoo|outlook|hotmail|mail",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|33|34|39|41|43|44|49|52|55|61|81|86|91)(?![0-9])",
    "contact": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$|gmail|yahoo|outlook|hotmail|mail",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}",
    "number": r"^\(?(?:2(?:0[1-9]|1[0-9]|2[0-9]|4[08]|5[1-6])|3(?:0[1-9]|1[0-9]|2[0-9])|4(?:0[1-9]|1[0-9]|25|43)|5(?:0[1-9]|1[0-9]|55)|6(?:0[1-9]|1[0-9]|46)|7(?:0[1-9]|1[0-9]|7[0-9])|8(?:0[0-9]|1[0-9]|88)|9(?:0[1-9]|1[0-9]))",
    "birth": r"19[0-9]{2}|200[0-9]",
    "address": r"(?:Main|High|Church|Park|Oak|Maple|Station|Haupt|Bahnhof|Garten|Mayor|Real) ?(?:Street|Road|Avenue|straße|strasse|,? [0-9])",
    "person": r" (?:Anna|Anne|Carlos|David|Elena|Hans|James|Jean|John|José|Juan|Karl|Laura|Maria|María|Marie|Martin|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sophie|Thomas|William)(?!\p{L})",
}
_OPEN = ("account", "phone", "person", "address")
# Words before a span that speak for it, and against it.
_CUES = r"(?i)(?:mail|contact|write|reach|phone|tel|call|fax|mobile|cell|ssn|social|iban|account|card|born|birth|dob|name|address|lives? (?:at|in)|patient|host|ip)[^A-Za-z0-9]*$|(?:mail|contact|phone|tel|call|fax|ssn|iban|born|birth|address)\b.{0,24}$"
_AGAINST = r"(?i)(?:isbn|issn|order|invoice|version|sku|serial|part|page|item|ref|case|patent|build|release|updated|published|founded|built)\b.{0,24}$"
#: Code points before a span in which cue words count; matches that are added up at a time.
CONTEXT, BLOCK = 40, 256

_SPAN = "array<struct<s:int,e:int,v:string,before:string>>"
_FEATURES = ("kind", "strict", "known", "cue", "spaced", "long", "line_start")
_BLANK = "\x00"


def found(text: Column, pattern: str, hint: Column) -> Column:
    """Matches of pattern where hint holds, else none."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, matches: Column, pattern: str) -> Column:
    """What lies before each match."""
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))


def _pairs(text: Column, matches: Column, pattern: str) -> Column:
    """The matches, each with the length and the end of what lies before it."""
    return F.zip_with(_gaps(text, matches, pattern), matches, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("v"), F.substring(gap, -CONTEXT, CONTEXT).alias("before")))


def _blocks(pairs: str) -> Column:
    """The column ``pairs`` in blocks of BLOCK, each with its length and its spans counted from its start. It is
    named twice, as what is named once is moved into the loop."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"), x["before"].alias("before")))).alias("out"))

    starts = F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(BLOCK))
    return F.when(F.size(pairs) > 0, F.transform(starts, lambda k: F.aggregate(F.slice(pairs, k + 1, F.lit(BLOCK)), empty, place)))


def _spans(blocks: str) -> Column:
    """The spans of all blocks, counted from the text's start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(blocks, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    moved = lambda x, o: F.transform(x["out"], lambda y: F.struct((y["s"] + o).alias("s"), (y["e"] + o).alias("e"), y["v"].alias("v"), y["before"].alias("before")))
    return F.coalesce(F.flatten(F.zip_with(blocks, offsets, moved)), F.array().cast(_SPAN))


def blanked(text: Column, matches: Column, pattern: str, holds) -> Column:
    """text with the matches that hold blanked out, as long as before."""
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda gap, v: F.concat(gap, F.when(holds(v), F.repeat(F.lit(_BLANK), F.length(v))).otherwise(v)))
    return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))


def _both(one: Column, other: Column) -> Column:
    """Blank where either is."""
    return F.array_join(F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: F.when(x == _BLANK, x).otherwise(y)), "")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (1 + (i + 1) % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _passing(kind: str):
    return lambda x: _HOLDS[kind](x["v"])


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that a match needs."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(_HINTS[kind]) if kind in _HINTS else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _voted(kind: str):
    """A span with its kind, votes and features."""

    def row(x: Column) -> Column:
        strict, known = x["v"].rlike(_STRICT[kind]) & _HOLDS.get(kind, lambda v: F.lit(True))(x["v"]), x["v"].rlike(_GAZETTEER[kind])
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _vote(strict, ~strict).alias("strict"), _vote(known, F.lit(kind not in _OPEN) & ~known).alias("known"),
            _vote(x["before"].rlike(_CUES), x["before"].rlike(_AGAINST)).alias("cue"), x["v"].contains(" ").cast("int").alias("spaced"), (F.length(x["v"]) > 16).cast("int").alias("long"), (x["before"] == "").cast("int").alias("line_start"),
        )

    return row


def spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base spans by kind, and ``voted`` and ``more``: matches of the fixed patterns and candidates, with votes and features."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[found(text, _PATTERNS[k], _hint(k, text)).alias(f"m_{k}") for k in BASE])
    rows = rows.select("*", *[_pairs(text, F.col(f"m_{k}"), _PATTERNS[k]).alias(f"p_{k}") for k in BASE])
    rows = rows.select("doc_id", "text", *[f"m_{k}" for k in BASE], *[_blocks(f"p_{k}").alias(f"b_{k}") for k in BASE])
    rows = rows.select("doc_id", "text", *[F.col(f"m_{k}") for k in BASE], *[_spans(f"b_{k}").alias(f"all_{k}") for k in BASE])
    rows = rows.select("*", *[F.filter(f"all_{k}", _passing(k)).alias(k) for k in BASE])
    blanks = F.filter(F.array(*[F.when(F.size(k) > 0, blanked(text, F.col(f"m_{k}"), _PATTERNS[k], _HOLDS[k])) for k in BASE]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", *BASE, *[f"all_{k}" for k in BASE], blanks.alias("blanks"), "text")
    rows = rows.withColumn("text", F.when(F.size("blanks") == 0, text).otherwise(F.aggregate(F.slice("blanks", F.lit(2), F.greatest(F.size("blanks") - 1, F.lit(0))), F.get("blanks", F.lit(0)), _both))).drop("blanks")
    for k in ADDED:
        pattern = _CANDIDATES[k]
        rows = rows.withColumn("m", found(text, pattern, _hint(k, text))).withColumn("p", _pairs(text, F.col("m"), pattern)).withColumn("b", _blocks("p")).withColumn(k, _spans("b"))
        if k != ADDED[-1]:
            rows = rows.withColumn("text", F.when(F.size("m") > 0, blanked(text, F.col("m"), pattern, lambda v: F.lit(True))).otherwise(text))
        rows = rows.drop("m", "p", "b")
    flat = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in BASE]
    voted = F.concat(*[F.transform(f"all_{k}", _voted(k)) for k in BASE])
    more = F.concat(*[F.transform(k, _voted(k)) for k in ADDED])
    return rows.select("doc_id", *flat, voted.alias("voted"), F.array_sort(more, lambda a, b: a["s"] - b["s"]).alias("more"))


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[tuple[float, float]]]]:
    """(share of true spans, per labeler its (P(vote | true), P(vote | false)) by vote) from counts of vote patterns."""
    n_votes = len(counts[0][0])
    share, rates = 0.5, [[(0.15, 0.5), (0.6, 0.15), (0.25, 0.35)] for _ in range(n_votes)]
    for _ in range(rounds):
        total, sums = 1e-9, [[[0.5, 0.5] for _ in range(3)] for _ in range(n_votes)]
        true = 1.0
        for votes, n in counts:
            p = posterior(votes, share, rates)
            true += n * p
            total += n
            for k, v in enumerate(votes):
                sums[k][v][0] += n * p
                sums[k][v][1] += n * (1 - p)
        share = min(0.99, max(0.01, true / (total + 2)))
        rates = [[(s[0] / sum(x[0] for x in own), s[1] / sum(x[1] for x in own)) for s in own] for own in sums]
    return share, rates


def posterior(votes: tuple[int, ...], share: float, rates: list[list[tuple[float, float]]]) -> float:
    yes, no = share, 1 - share
    for own, v in zip(rates, votes, strict=True):
        yes, no = yes * own[v][0], no * own[v][1]
    return yes / (yes + no) if yes + no > 0 else share


def _inputs(row: tuple) -> list[tuple[str, int]]:
    """The features of the classifier that are on."""
    return [(name, value) for name, value in zip(_FEATURES, row, strict=True) if value != 2]


def train(rows: list[tuple[tuple, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Logistic weights by feature and value, fitted to the posteriors of the vote patterns; None: the intercept."""
    if not rows:
        return {}
    share, rates = expectation_maximisation([(r[1:4], n) for r, n in rows])
    data = [(_inputs(r), n, posterior(r[1:4], share, rates)) for r, n in rows]
    total = sum(n for _, n, _ in data)
    weights: dict = {None: math.log(share / (1 - share))} | {x: 0.0 for on, _, _ in data for x in on}
    for _ in range(rounds):
        step = dict.fromkeys(weights, 0.0)
        for on, n, p in data:
            error = n / total * (p - 1 / (1 + math.exp(-(weights[None] + sum(weights[x] for x in on)))))
            for x in (None, *on):
                step[x] += error
        weights = {x: w * (1 - rate * decay) + rate * step[x] for x, w in weights.items()}
    return weights


def model(found_spans: DataFrame) -> dict:
    """The classifier's weights, from the counts of all spans by discrete features."""
    each = found_spans.select(F.explode(F.concat("voted", "more")).alias("x"))
    rows = each.groupBy(*[F.col(f"x.{k}").alias(k) for k in _FEATURES]).count().collect()
    return train(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def _probable(weights: dict):
    def keep(x: Column) -> Column:
        score = F.lit(weights.get(None, -1.0))
        for (name, value), w in sorted(((k, w) for k, w in weights.items() if k), key=str):
            score = score + F.when(x[name] == F.lit(value), F.lit(w)).otherwise(0.0)
        return score > 0

    return keep


def detect(docs: DataFrame, lasting) -> DataFrame:
    """Per row: doc_id, base spans by kind (``email`` ...), and ``added``: spans that the classifier accepts."""
    rows = lasting(spans(docs))
    weights = model(rows)
    likely = F.filter("more", _probable(weights)) if weights else F.filter("more", lambda x: F.lit(False))
    return rows.select("doc_id", *BASE, F.transform(likely, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("added"))


def joined(*kinds: tuple[str, Column]) -> Column:
    """kind:start:end of arrays of spans in order of start, kind by kind, joined by commas."""

    def text(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))

    return F.concat_ws(",", F.concat(*[F.transform(F.array_sort(own), text(k)) for k, own in kinds]))
