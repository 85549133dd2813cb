"""Personal data by patterns and by what the corpus reveals (operator 5,
DataFrame functions only).

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and
check.  Method (information-theoretic sanitisation): every distinct value
found is a protected entity ``e``.  With document counts over the whole
corpus, a term ``t`` (a run of letters, lower case) written within
``WINDOW`` words of ``e`` discloses the share

    PMI(t, e) / IC(e) = 1 + log2(n(t, e) / n(t)) / log2(N / n(e))

of the entity's information content.  All four numbers count different texts
(copies of a text, and repeated rows, count once).  Where fewer than
``EVIDENCE`` texts show the two together, ``n(t)`` is raised by half the
missing ones, as if the term stood elsewhere too: an estimate from below that
still flags a term in one or two texts where the corpus is large enough for
that to mean something.  Terms are generalised from ``GENERALISE`` on and
removed from ``REMOVE`` on, wherever in the corpus they stand.  An entity in
every text has no information to protect.

Defined results: null text is empty; no finds give empty strings and zero
counts, with the digest of the empty string; terms overlapping a base span
are not added; repeated rows have the same finds each; rows without an id are
counted and sanitised like others; an empty table gives an empty result; very
long texts are taken whole; columns of the caller that are named like an
operator's own stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstat.llm.common import SPACE, let, materialise, pack

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
WINDOW = 5             # words on each side of an entity
CONTEXT_CHARS = 200    # characters in which those words are looked for first
MIN_TERM = 3           # letters
EVIDENCE = 3           # texts from which on an estimate is taken as it is
GENERALISE, REMOVE = 0.95, 0.99
CHUNK = 128

# The contract's patterns, written so that each run of characters is tried
# once (possessive loops; a match starts at a run's start or where the last
# match ended), which finds the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LETTERS = r"\p{L}+"


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array, in chunks: work grows with
    ``n * CHUNK``, not with the square of ``n``."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def over(a: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(a, c * CHUNK + 1, F.lit(CHUNK))))
        bases = let(sums, lambda s: F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))))

        def within(part: Column, base: Column) -> Column:
            return F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1)))
        return F.flatten(F.transform(bases, lambda base, c: let(
            F.slice(a, c * CHUNK + 1, F.lit(CHUNK)), lambda part: within(part, base))))
    return let(lengths, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(over(a)))


def matches(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's matches: lengths
    of the pieces between matches and of the matches add up to positions."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(m: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            return F.zip_with(m, ends, lambda v, e: F.struct(
                (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        gaps = F.split(text, p, -1)
        steps = F.zip_with(m, gaps, lambda v, g: F.coalesce(F.length(v) + F.length(g), F.lit(0)))
        return let(running_sums(F.slice(let(steps, lambda s: s), F.lit(1), F.size(m))), with_ends)

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def check(d: Column) -> Column:
        def digit(i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            y = x * 2
            return F.when((F.length(d) - i) % 2 == 0, x).otherwise(F.when(y > 9, y - 9).otherwise(y))
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0
    return let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), check(d)).otherwise(F.lit(False)))


def _ip_ok(v: Column) -> Column:
    return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


_KIND_RULES = (
    ("email", EMAIL, lambda t: t.contains("@"), None),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip_ok),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _luhn),
    ("phone", PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda v: F.length(_digits(v)).between(9, 15)),
)
_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,value:string>>"


def base_spans(text: Column) -> Column:
    """Base finds as ``array<struct<start, kind_no, end, value>>`` by start, then kind."""
    def of_kind(no: int, pattern: str, hint, valid) -> Column:
        every = matches(text, pattern)
        kept = every if valid is None else F.filter(every, lambda m: valid(m["value"]))
        return F.when(hint(text), _as_spans(kept, no)).otherwise(F.array().cast(_SPANS))
    return F.sort_array(F.concat(*[of_kind(no, *rule[1:]) for no, rule in enumerate(_KIND_RULES)]))


def _as_spans(found: Column, kind_no: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind_no).alias("kind_no"), m["end"].alias("end"), m["value"].alias("value")))


def _count(spans: Column, kind_no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == kind_no)).cast("bigint")


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0)), lambda t: F.length(t) >= MIN_TERM)


def mentions(docs: DataFrame) -> DataFrame:
    """One row per base find: ``entity, digest`` (a hash of the whole text) and
    the ``terms`` among the words around it."""
    spans = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
             .filter(F.col("_text").rlike(r"[@+]|[0-9][\x20.-]?[0-9]"))
             .select("doc_id", "_text", base_spans(F.col("_text")).alias("_s")).filter(F.size("_s") > 0))
    one = spans.select("doc_id", "_text", F.explode("_s").alias("s"))
    start, end = F.col("s.start").cast("int"), F.col("s.end").cast("int")
    length = F.length("_text")

    def words_in(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(rf"[^{SPACE}]+"), F.lit(0))

    def nearest(part: Column, whole: Column, cut: Column, last: bool) -> Column:
        """The ``WINDOW`` words at one end of ``whole``: from ``part``, its nearest
        characters, unless they hold fewer (the word cut by the edge doesn't count)."""
        def take(w: Column) -> Column:
            return F.slice(w, F.greatest(F.size(w) - WINDOW, F.lit(0)) + 1 if last else F.lit(1), F.lit(WINDOW))

        def chosen(w: Column) -> Column:
            sure = F.slice(w, F.lit(2 if last else 1), F.size(w) - 1)
            return F.when(~cut, take(w)).when(F.size(w) > WINDOW, let(sure, take)).otherwise(let(words_in(whole), take))
        return let(words_in(part), chosen)
    before = nearest(F.substring("_text", F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))),
                     F.substring("_text", F.lit(1), start), start > CONTEXT_CHARS, True)
    after = nearest(F.substring("_text", end + 1, F.lit(CONTEXT_CHARS)), F.substring("_text", end + 1, length - end),
                    length - end > CONTEXT_CHARS, False)
    near = F.array_join(F.concat(before, F.array(F.lit("")), after), " ")
    return one.select(F.concat(F.col("s.kind_no"), F.lit(":"), F.lower("s.value")).alias("entity"),
                      F.xxhash64("_text").alias("digest"), near.alias("_near")).select(
        "entity", "digest", F.array_distinct(_terms(F.col("_near"))).alias("terms"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term, disclosure, kind`` of the terms above the thresholds."""
    found = materialise(mentions(docs), "pii-mentions")
    n_texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("d")).distinct().count()
    # an entity's texts: distinct pairs first, so a very common one is reduced before the shuffle
    n_e = found.select("entity", "digest").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    near = found.select("entity", "digest", F.explode("terms").alias("term")).distinct()
    ic = F.log2(F.lit(float(max(n_texts, 1))) / F.col("n_e"))

    def share(n_t: Column) -> Column:
        unseen = F.greatest(EVIDENCE - F.col("n_te"), F.lit(0)) / 2
        return F.when(ic > 0, 1 + F.log2(F.least(F.col("n_te") / (n_t + unseen), F.lit(1.0))) / ic).otherwise(F.lit(0.0))
    # texts with the term near any entity: at most n(t), so a term whose share is too small with
    # them (most common words) is too small with all texts and needn't be counted in the corpus
    n_near = near.select("term", "digest").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = (near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).join(n_e, "entity").join(n_near, "term")
             .filter(share(F.col("n_near")) >= GENERALISE))
    pairs = materialise(pairs.select("term", "n_te", "n_e"), "pii-pairs")
    candidates = materialise(pairs.select("term").distinct(), "pii-candidates")
    n_t = (_doc_terms(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")).join(candidates, "term", "left_semi")
           .distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    scored = pairs.join(n_t, "term").groupBy("term").agg(F.max(share(F.col("n_t"))).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= GENERALISE).select(
        "term", "disclosure", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("kind"))


def _doc_terms(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(key, F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``_row`` (the given columns), ``text`` (null as empty) and ``spans``:
    ``array<struct<start, kind_no, end, value>>``."""
    flagged = materialise(disclosing_terms(docs), "pii-terms")
    # documents with a flagged term, and their flagged terms (few, bounded by the document's words)
    hits = _doc_terms(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hit_text")).join(flagged.select("term", "kind"), "term")
    per_doc = materialise(hits.groupBy("_hit_text").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "generalise", F.col("term")))), "|").alias("_generalise"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "remove", F.col("term")))), "|").alias("_remove"),
    ), "pii-hits")
    rows = docs.select(pack(docs), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(per_doc, F.xxhash64("text") == F.col("_hit_text"), "left")
    base = rows.select("_row", "text", "_generalise", "_remove", base_spans(F.col("text")).alias("_base"))

    def extra(column: str) -> Column:
        # letter runs have no special characters, so they can stand in a pattern as they are
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col(column), F.lit(r")(?!\p{L})"))
        no = KINDS.index(column[1:])
        spans = _as_spans(matches(F.col("text"), pattern), no)
        free = F.filter(spans, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", free).otherwise(F.array().cast(_SPANS))

    return base.select("_row", "text", "_base", F.sort_array(F.concat("_base", extra("_generalise"), extra("_remove"))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = find_personal_data(docs.select("doc_id", "text"))
    counts = [_count(F.col("_base"), no).alias(f"n_{kind}") for no, kind in enumerate(KINDS[:4])]
    return found.select("_row.doc_id", *counts, F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (null stays null):
    ``[EMAIL]`` and the like, ``[TERM]`` for generalised terms, nothing for
    removed ones.  A span that begins inside an earlier one extends it."""
    found = find_personal_data(docs)
    marks = F.array(*[F.lit(m) for m in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")])
    text = F.col("text")
    state = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit("").alias("out"))
    done = F.aggregate("spans", state, lambda acc, s: F.when(
        s["start"] >= acc["upto"],
        F.struct(s["end"].alias("upto"), F.concat(
            acc["out"], F.substring(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")),
            marks[s["kind_no"]]).alias("out"))).otherwise(
        F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["upto"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.col("_row.text").isNull(), F.lit(None).cast("string")).when(F.size("spans") == 0, text).otherwise(done)
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
