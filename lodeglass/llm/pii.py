r"""Personal data by weak supervision.

Patterns propose candidate spans. Base spans (patterns and their checks) are always reported. For each candidate, labelers vote yes, no or
nothing: the strict form of its kind, gazetteers (top-level domains, country codes, card issuers, reserved networks), cue words before it, words
and characters that speak against it, its borders, and placeholders. Expectation-maximisation over the counts of vote patterns estimates, per
kind, how reliable each labeler is, without any labels. Its posteriors are soft labels for the final span classifier, naive Bayes over
features of the span and its surroundings; candidates that it accepts are added, unless they overlap a base span.

All of it is column expressions. A vote pattern has one of 3 ** LABELERS values per kind, so the table that the estimation runs on is
bounded whatever the corpus; it is one row per kind, and the rounds are one expression over it. Texts never move; candidates are
found in linear time (patterns start at the border of a run, or where the last match ended).

Spans count code points, ends exclusive. Null texts are empty. Repeated rows are judged each. Without candidates the model is empty, and base spans alone
are reported. Extra columns are ignored (`redact` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.storage import materialize

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = KINDS[:4]
LABELERS, ROUNDS, SMOOTHING = 6, 25, 1.0
_CHARS = r"[A-Za-z0-9._%+-]"

#: name: kind, pattern, a cheaper test that texts with a match pass, whether its checked matches are base spans.
PATTERNS = {
    "email": ("email", rf"(?:\G|(?<!{_CHARS})){_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    "ip": ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", True),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    "hidden_email": ("email", rf"(?<!{_CHARS}){_CHARS}{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++", r"[(\[]at[)\]]", False),
    "local_phone": ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-]?[0-9A-Za-z])", r"[0-9]{3}[\x20.-][0-9]{4}", False),
    "ssn": ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]", False),
    "iban": ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", False),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9][A-Za-z0-9\x20().\[\]-]*[A-Za-z]{2,24}$",
    "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,}$",
}
GAZETTEER = {
    "email": r"(?i)[.\x20)\]](?:com|org|net|edu|gov|int|info|biz|eu|de|fr|es|it|uk|us|ca|au|ch|at|nl|be|se|no|dk|fi|pl|pt|ie|in|jp|cn|br|mx|ru|io|co|me)$",
    "ip": r"^(?!0|10\.|127\.|192\.168\.|169\.254\.|2(?:2[4-9]|[3-9][0-9])\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    "ssn": r"^[0-7]",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|NL|NO|PL|PT|RO|SE|SI|SK)",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel|address)",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|login|client|network)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|cell|dial|whatsapp|telefon|tel[eé]fono)",
    "ssn": r"(?i)(?:ssn|social|security)",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)",
}
AGAINST = r"(?i)(?:version|build|isbn|issn|doi|invoice|order|serial|section|page|art\.|[$€£#=/:v])\x20?$"
PLACEHOLDER = r"(?i)(?:^test|noreply|no-reply|your|^(.)(?:[\x20.()-]*\1)+$|123[\x20-]?45[\x20-]?6789|^0\.0\.0\.0$|555-01)"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = (F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48) * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _checked(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return match.rlike(STRICT["ip"])
    if kind == "card":
        return _let(_digits(match), lambda d: F.length(d).between(16, 19) & luhn(F.when(F.length(d).between(16, 19), d).otherwise("0")))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, 0).when(yes, 2).otherwise(1)


def _candidate(kind: str, base: bool, s: Column) -> Column:
    """From a span with its surroundings: kind, bounds, base flag, votes (0 no, 1 nothing, 2 yes) and features."""
    m, before, after = s["m"], s["before"], s["after"]
    checked = _checked(kind, m)
    strict = checked if kind == "card" else m.rlike(STRICT[kind])
    known = m.rlike(GAZETTEER[kind])
    cue, against = before.rlike(CUES[kind]), before.rlike(AGAINST)
    tight = before.rlike(r"[0-9A-Za-z_]$") | after.rlike(r"^[0-9A-Za-z_]")
    votes = F.array(_vote(strict, ~strict), _vote(known, ~known), _vote(cue, F.lit(False)), _vote(F.lit(False), against), _vote(~tight, tight), _vote(F.lit(False), m.rlike(PLACEHOLDER)))
    shape = lambda c: F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").otherwise("mark")
    n = F.length(_digits(m))
    features = F.array(
        F.concat(F.lit("b:"), shape(F.right(before, F.lit(1)))), F.concat(F.lit("a:"), shape(F.left(after, F.lit(1)))),
        F.concat(F.lit("c:"), cue.cast("string")), F.concat(F.lit("l:"), F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("d:"), F.least(n, F.lit(20)).cast("string")), F.concat(F.lit("s:"), strict.cast("string")),
    )
    own = checked if base else F.lit(False)
    # A card that fails its checksum is none, whatever stands around it, nor is a number of another length a phone's.
    possible = checked if kind == "card" else strict & checked if kind == "phone" else strict
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), own.alias("base"), possible.alias("possible"), votes.alias("votes"), features.alias("features"))


def _as_candidate(kind: str, base: bool):
    return lambda s: _candidate(kind, base, s)


def candidates(df: DataFrame, text: str, keep: list[str], out: str) -> DataFrame:
    """`keep` and the candidates of each text, as array `out`."""
    body = F.coalesce(F.col(text), F.lit(""))
    columns = []
    for name, (_, pattern, test, _) in PATTERNS.items():
        possible = body.contains(test) if len(test) == 1 else body.rlike(test)
        # The text around and between the matches, and the matches: split and extract find the same ones.
        columns += [F.when(possible, F.split(body, pattern, -1)).alias(f"_p_{name}"), F.when(possible, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias(f"_m_{name}")]
    first = df.select(*keep, *columns)
    none = "array<struct<start:int,end:int,m:string,before:string,after:string>>"

    def spans(name):
        parts, found = F.col(f"_p_{name}"), F.col(f"_m_{name}")

        def step(acc, i):
            start = acc["at"] + F.length(F.get(parts, i))
            end = start + F.length(F.get(found, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("m"), F.right(F.get(parts, i), F.lit(40)).alias("before"), F.left(F.get(parts, i + 1), F.lit(8)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["out"]))

    second = first.select(*keep, *[spans(name).alias(f"_s_{name}") for name in PATTERNS])
    lists = []
    for name, (kind, _, _, base) in PATTERNS.items():
        found = F.col(f"_s_{name}")
        if kind == "card":  # runs of digits that are no cards at all are not candidates
            found = F.filter(found, lambda s: F.length(_digits(s["m"])).between(16, 19))
        own = F.transform(found, _as_candidate(kind, base))
        lists.append(F.coalesce(own, F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,possible:boolean,votes:array<int>,features:array<string>>>")))
    return second.select(*keep, F.concat(*lists).alias(out))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From (kind, votes, n): one row per kind, `w`: array of (votes, n, q), q the posterior that a candidate with these votes is personal data.

    Two-class model with independent labelers (Dawid and Skene), started from the vote sums.
    """
    grouped = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("w"))
    prior = lambda p: 1 / (1 + F.exp(-(F.aggregate(p["votes"], F.lit(0), lambda a, v: a + v - 1).cast("double"))))
    start = F.transform("w", lambda p: F.struct(p["votes"].alias("votes"), p["n"].cast("double").alias("n"), prior(p).alias("q")))

    def share(w, labeler, value, yes):
        weight = lambda p: p["n"] * (p["q"] if yes else 1 - p["q"])
        hit = F.aggregate(w, F.lit(0.0), lambda a, p: a + F.when(F.get(p["votes"], F.lit(labeler)) == value, weight(p)).otherwise(0.0))
        return F.log((hit + SMOOTHING) / (F.aggregate(w, F.lit(0.0), lambda a, p: a + weight(p)) + 3 * SMOOTHING))

    def table(w, yes):
        return F.array(*[F.array(*[share(w, labeler, value, yes) for value in range(3)]) for labeler in range(LABELERS)])

    def round_(w, _):
        total = F.aggregate(w, F.lit(0.0), lambda a, p: a + p["n"])
        mean = (F.aggregate(w, F.lit(0.0), lambda a, p: a + p["n"] * p["q"]) + SMOOTHING) / (total + 2 * SMOOTHING)
        model = F.struct(F.log(mean / (1 - mean)).alias("odds"), table(w, True).alias("yes"), table(w, False).alias("no"))

        def update(t):
            def q(p):
                each = F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), t["odds"], lambda a, i: a + F.get(F.get(t["yes"], i), F.get(p["votes"], i)) - F.get(F.get(t["no"], i), F.get(p["votes"], i)))
                return 1 / (1 + F.exp(-each))

            return F.transform(w, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), q(p).alias("q")))

        return _let(model, update)

    return grouped.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("w"))


def fit(found: DataFrame, column: str) -> dict[str, dict[str, float]]:
    """The span classifier of each kind, from candidates in array `column`: log odds of each feature value, and "" for the prior.

    Counts are combined per task before they move; what reaches the driver is a weight per kind and feature value (under 100 a kind).
    """
    flat = found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    flat = materialize(flat, "votes")
    soft = reliabilities(flat.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).select("kind", F.explode("w").alias("w")).select("kind", "w.votes", "w.q")
    joined = flat.join(soft, ["kind", "votes"])
    yes, no = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    totals = joined.groupBy("kind").agg(yes.alias("yes"), no.alias("no"))
    values = joined.select("kind", "n", "q", F.explode("features").alias("f")).groupBy("kind", "f").agg(yes.alias("y"), no.alias("x")).join(totals, "kind")
    weights = values.select("kind", "f", (F.log((F.col("y") + SMOOTHING) / (F.col("yes") + 2 * SMOOTHING)) - F.log((F.col("x") + SMOOTHING) / (F.col("no") + 2 * SMOOTHING))).alias("weight"))
    weights = weights.union(totals.select("kind", F.lit(""), F.log((F.col("yes") + SMOOTHING) / (F.col("no") + SMOOTHING))))
    model: dict[str, dict[str, float]] = {}
    for row in weights.collect():
        model.setdefault(row["kind"], {})[row["f"]] = row["weight"]
    return model


def accepted(column: str, model: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """(base spans, added spans) of the candidates in `column`: added are those that the classifier accepts and that overlap no base span or
    earlier added one; each ordered by kind as listed, then start."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    plain = lambda c: F.struct(F.element_at(order, c["kind"]).alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    base = F.array_sort(F.transform(F.filter(column, lambda c: c["base"]), plain))
    entries = [F.lit(x) for k, own in sorted(model.items()) for f, w in sorted(own.items()) for x in (f"{k}|{f}", float(w))]
    if not entries:
        return base, F.slice(base, 1, 0)
    weights = F.create_map(*entries)
    weight = lambda key: F.coalesce(F.try_element_at(weights, key), F.lit(0.0))
    odds = lambda c: F.aggregate(c["features"], weight(F.concat(c["kind"], F.lit("|"))), lambda a, f: a + weight(F.concat(c["kind"], F.lit("|"), f)))
    free = lambda c: ~F.exists(F.filter(column, lambda b: b["base"]), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.array_sort(F.transform(F.filter(column, lambda c: ~c["base"] & c["possible"] & (odds(c) > 0) & free(c)), plain))
    apart = lambda acc, c: F.when(F.exists(acc, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), acc).otherwise(F.concat(acc, F.array(c)))
    return base, F.aggregate(added, F.slice(added, 1, 0), apart)


def detect(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans, n_added."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    found = materialize(candidates(rows, "_text", ["doc_id"], "_found"), "candidates")
    base, added = accepted("_found", fit(found, "_found"))
    spans = found.select("doc_id", base.alias("base"), added.alias("added"))
    name = lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with all their columns; in `text` every span is replaced by its kind in brackets. Null texts stay null. Candidates are written once
    beside the documents: the classifier is learned from their column alone and then applied to the table."""
    row, found, spans = "_document", "_found", "_spans"
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row), F.col(text).alias("_text"))
    beside = materialize(candidates(packed, "_text", [row], found), "candidates")
    base, added = accepted(found, fit(beside, found))
    by_place = F.array_sort(F.transform(F.concat(base, added), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    marked = beside.select(row, by_place.alias(spans))
    body = F.col(row)[text]

    def put(acc, c):
        part = F.substr(body, acc["at"] + 1, F.greatest(F.lit(0), c["start"] - acc["at"]))
        mark = F.when(c["start"] >= acc["at"], F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise("")  # overlapping ones share the first mark
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.concat(acc["out"], F.array(F.concat(part, mark))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(spans, begin, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1, F.length(body))))
    new = F.when(F.size(spans) > 0, clean).otherwise(body)
    out = [(new if c == text else F.when((F.size(spans) > 0) & F.col(row)[c].isNotNull(), F.length(new)).otherwise(F.col(row)[c]).cast("long") if c == "n_chars" else F.col(row)[c]).alias(c) for c in documents.columns]
    return marked.select(*out)
