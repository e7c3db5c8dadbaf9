r"""Information-theoretic sanitisation of personal data.

Base: patterns find e-mail addresses, IP addresses, card and phone numbers.
Every value found is a protected entity. From the whole corpus, co-occurrence
then estimates how strongly a term reveals an entity near which it stands:

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 - log(n_t / n_te) / log(N / n_e)

with N the documents, n_e those with the entity, n_t those with the term, n_te
those with the term near the entity. Terms are whole words of three letters or
more; other entities nearby are no surroundings. It is 1 when a term occurs near the entity
alone, about 0 when the two are independent. Every term that stands in at least
``min_contexts`` different surroundings of an entity, whatever its neighbours there
(copies of a passage are one), is judged:
from ``generalise_at`` on they are replaced by what the entity is, from
``remove_at`` on removed, in every document.

All of it is column expressions and joins. Counts are summed before each
shuffle; term tables are broadcast only when a count shows them small, else
joined by shuffle; findings meet documents by the SHA-256 of the text, so that
ids may be null or repeated.

Patterns are the contract's, with possessive quantifiers where nothing can give
back, and may start only where a run of their characters starts (or the match
before ended): linear on any text. Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty; a match that fails its check is
dropped, and the search goes on behind it; rows that are alike get alike spans;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_from, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match that can pass its check.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Code points on either side of an entity that are its surroundings.
NEAR = 80
MIN_CONTEXTS = 3
GENERALISE_AT = 0.7
REMOVE_AT = 0.9
#: A table of terms is broadcast up to this many rows.
MAX_BROADCAST = 100_000
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}"


def found(text: Column, pattern) -> Column:
    """All matches with their places: array of struct(s, e, m)."""
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    matches, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    steps = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    def step(total, k):
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array of struct(s, e, m) of one kind."""
    may = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(may, F.filter(found(text, PATTERNS[kind]), lambda x: _holds(kind, x["m"]))).otherwise(none)


def _value(kind: str, m: Column) -> Column:
    """The entity that a match stands for, however it is written."""
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]", ""))


def _surroundings(text: Column, x: Column) -> Column:
    """Whole words within NEAR code points of a span."""
    start = F.greatest(x["s"] - NEAR, F.lit(0))
    before = F.substring(text, start + 1, x["s"] - start)
    after = F.substring(text, x["e"] + 1, F.lit(NEAR))
    before = F.when(start > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = F.when(F.length(after) == NEAR, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.lower(F.concat(before, F.lit(" \n "), after))


def _masked(text: Column, spans_: Column) -> Column:
    """text with each span's characters as spaces, so that other places stay."""
    def step(acc, x):
        s = F.greatest(x["s"], acc["at"])
        kept = F.substring(text, acc["at"] + 1, s - acc["at"])
        blank = F.repeat(F.lit(" "), F.greatest(x["e"] - s, F.lit(0)))
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.concat(acc["out"], kept, blank).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.array_sort(spans_), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans_) > 0, whole).otherwise(text)


def _small(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """A staged df, broadcast if its rows are few; else joins shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base spans of each row and the surroundings of each entity, staged: id, sha, one span array a kind, near."""
    t = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    t = t.withColumns({k: base_spans(F.col("t"), k) for k in KINDS})
    t = t.withColumn("masked", _masked(F.col("t"), F.concat(*KINDS)))

    def near(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(_value(kind, x["m"]).alias("entity"), _surroundings(F.col("masked"), x).alias("around")))

    return stage(t.select("id", F.sha2("t", 256).alias("sha"), *KINDS, F.concat(*map(near, KINDS)).alias("near")), "pii-scan")


def disclosing_terms(df: DataFrame, scanned: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame | None:
    """term, kind of the entity it reveals most, disclosure, removed; None if no term has enough contexts."""
    terms = lambda around: F.regexp_extract_all(around, F.lit(TERM), F.lit(0))
    total = float(scanned.count())
    # documents, not occurrences, are counted: what a document tells of an entity is put together first
    told = F.transform(F.array_distinct(F.transform("near", lambda x: x["entity"])), lambda e: F.struct(e.alias("entity"), F.array_distinct(F.transform(F.filter("near", lambda x: x["entity"] == e), lambda x: x["around"])).alias("arounds")))
    seen = scanned.select(F.explode(told).alias("x")).select("x.entity", "x.arounds").groupBy("entity", "arounds").agg(F.count("*").alias("n"))
    entities = seen.groupBy("entity").agg(F.sum("n").alias("n_e"))
    near = seen.select("entity", "arounds", F.explode(F.array_distinct(F.flatten(F.transform("arounds", terms)))).alias("term"), "n")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_te")).where(F.col("contexts") >= min_contexts)
    pairs = stage(pairs.join(entities, "entity").select("entity", "term", "n_te", "n_e"), "pii-near")
    # a term near entities in more texts than any of its entities allows can't reach the threshold; both sides have a term once
    most = F.max(F.col("n_te") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - generalise_at)))
    widely = scanned.select("sha", F.explode(F.array_distinct(F.flatten(F.transform("near", lambda x: terms(x["around"]))))).alias("term")).groupBy("term").agg(F.count_distinct("sha").alias("texts"))
    kept = pairs.groupBy("term").agg(most.alias("most")).join(widely, "term").where(F.col("texts") <= F.col("most")).select("term")
    pairs = pairs.join(_small(stage(kept, "pii-kept")), "term")
    candidates = stage(pairs.select("entity", "term", "n_te", "n_e"), "pii-pairs")
    if candidates.isEmpty():
        return None
    n_t = df.select(F.explode(_terms_of(text_or_empty(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    share = 1 - F.log(F.greatest(F.col("n_t") / F.col("n_te"), F.lit(1.0))) / F.log(F.lit(total) / F.col("n_e"))
    judged = candidates.join(n_t, "term").where(F.col("n_e") < total).withColumn("disclosure", share).where(F.col("disclosure") >= generalise_at)
    kind = F.max_by(F.substring_index("entity", ":", 1), F.struct("disclosure", "entity"))
    return stage(judged.groupBy("term").agg(kind.alias("kind"), F.max("disclosure").alias("disclosure")).withColumn("removed", F.col("disclosure") >= remove_at), "pii-terms")


def term_spans(df: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """sha and term spans of each different text that holds one of the terms."""
    texts = df.select(text_or_empty(text_col).alias("t")).withColumn("sha", F.sha2("t", 256))
    held = texts.select("sha", F.explode(_terms_of(F.col("t"))).alias("term")).join(_small(terms), "term")
    lists = stage(held.groupBy("sha").agg(F.collect_set(F.struct("term", "kind", "removed")).alias("known")), "pii-lists")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("known", lambda x: x["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    hits = texts.join(_small(lists), "sha").select("sha", found(F.col("t"), pattern).alias("hits"), "known")
    return hits.groupBy("sha").agg(F.any_value("hits").alias("hits"), F.any_value("known").alias("known"))


def spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **thresholds) -> DataFrame:
    """id, sha, a span array a kind, and terms: array of struct(s, e, m, kind, removed) outside the base spans."""
    scanned = scan(df, text_col, id_col)
    terms = disclosing_terms(df, scanned, text_col, **thresholds)
    empty = F.array().cast("array<struct<s:int,e:int,m:string,kind:string,removed:boolean>>")
    if terms is None:
        return scanned.select("id", "sha", *KINDS, empty.alias("terms"))
    base = F.concat(*KINDS)
    apart = F.filter("hits", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    def labelled(x):
        known = F.get(F.filter("known", lambda k: k["term"] == F.lower(x["m"])), F.lit(0))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), known["kind"].alias("kind"), known["removed"].alias("removed"))

    # a text that many rows have meets its spans in as many tasks as it needs
    least = hot_from(scanned.count())
    hot = scanned.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("sha", F.ceil(F.col("n") / least).alias("salts"))  # common.HOT_SHARE rows at most
    hot = F.broadcast(stage(hot, "pii-hot"))
    salts = F.coalesce("salts", F.lit(1))
    told = term_spans(df, terms, text_col).join(hot, "sha", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    rows = scanned.drop("near").join(hot, "sha", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("salts")
    joined = rows.join(told, ["sha", "salt"], "left")
    return joined.select("id", "sha", *KINDS, F.coalesce(F.transform(apart, labelled), empty).alias("terms"))


def _joined(kind: str, of: str) -> Column:
    return F.transform(of, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **thresholds) -> DataFrame:
    """The digest of each row: counts, base_sha256 and spans; n_terms, and actions: what becomes of each term (removed, or generalised to the entity's kind) and where."""
    base = F.concat(*[_joined(k, k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    action = lambda x: F.concat_ws(":", F.when(x["removed"], F.lit("removed")).otherwise(F.concat(F.lit("generalised to "), x["kind"])), x["s"].cast("string"), x["e"].cast("string"))
    return spans(df, text_col, id_col, **thresholds).select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("term", "terms")), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
        F.array_join(F.transform("terms", action), ",").alias("actions"),
    )


def redact(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **thresholds) -> DataFrame:
    """sha (of the text, SHA-256) and the sanitised text of each different text of df: entities and generalised terms become [KIND], removed terms go."""
    mark = lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    cut = lambda x, put: F.struct(x["s"].alias("s"), x["e"].alias("e"), put.alias("put"))
    marked = lambda kind: F.transform(kind, lambda x: cut(x, mark(F.lit(kind))))
    arrays = [marked(k) for k in KINDS]
    arrays.append(F.transform("terms", lambda x: cut(x, F.when(x["removed"], F.lit("")).otherwise(mark(x["kind"])))))
    cuts = spans(df, text_col, id_col, **thresholds).groupBy("sha").agg(F.any_value(F.array_sort(F.concat(*arrays))).alias("cuts"))
    texts = df.select(text_or_empty(text_col).alias("t")).withColumn("sha", F.sha2("t", 256))

    def step(acc, x):
        grown = F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, x["s"] - acc["at"]), x["put"])
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), grown.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    whole = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    return texts.dropDuplicates(["sha"]).join(cuts, "sha").select("sha", whole.alias("text"))
