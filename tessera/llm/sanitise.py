"""Personal data and the terms that give it away, in DataFrame operations only.

Base spans (e-mail, IP address, payment card, phone) are found by pattern. Each value found is a
protected entity. The corpus then says how strongly a word reveals an entity:

    PMI(e; t) = log2(N * df(e, t) / (df(e) * df(t))),   IC(e) = log2(N / df(e))

with N documents, df(t) those with the word t, df(e) those with the entity and df(e, t) those with the
entity and, anywhere outside base spans, t. PMI(e; t) / IC(e) is 1 where t occurs with e only, so that
t discloses all of e. Words whose ratio with any entity reaches ``remove`` are removed, those reaching
``generalise`` are replaced by their class, wherever they stand: beside the entity, further on, or
in documents without it. A pair needs ``support`` different pieces of evidence, as copies of one passage
are one and a word seen once proves nothing: documents with both whose words around t differ, or
different contexts of the entity with t among the closest words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table_of

# The patterns of the four kinds, in order. Each finds the same leftmost matches as its plain form
# in linear time: runs are taken whole (possessive), and a match starts at the start of a run
# or where the last match ended, never at each place inside a run.
KINDS: list[tuple[str, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TERM = r"[\p{L}\p{M}\p{N}]++"
APART = (r"(?<![\p{L}\p{M}\p{N}])(?:", r")(?![\p{L}\p{M}\p{N}])")  # around words to be found whole
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
NEAR_CHARS = 100
BLOCK = 256
PART = 1024  # code points of a text that a position is looked for in
TERM_PART = 4096  # code points in which words are looked for at once
NEAR_WORDS = 5
PASSAGE_WORDS = 16
REMOVE, GENERALISE, SUPPORT = 0.9, 0.8, 2

_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.value, '\\.'), p -> coalesce(try_cast(regexp_replace(p, '^0+(?=[0-9])', '') as int), 256) <= 255)",
    "card": (f"aggregate(sequence(1, length({_DIGITS})), 0L, (sum, i) -> sum + "
             f"case when i % 2 = 1 then cast(substring({_DIGITS}, -i, 1) as int) "
             f"else (cast(substring({_DIGITS}, -i, 1) as int) * 2) div 10 "
             f"+ (cast(substring({_DIGITS}, -i, 1) as int) * 2) % 10 end) % 10 = 0"),
    "phone": f"length({_DIGITS}) between 10 and 15",
}
_SPAN = ("struct<place:int,kind:string,start:bigint,stop:bigint,value:string,before:string,after:string>")


def _spans(place: int, kind: str, found: str, gaps: str, origin: str = "0L") -> str:
    """SQL for the spans of matches ``found`` lying between ``gaps``; positions are code points.

    Running positions are summed within blocks of BLOCK matches and then over blocks, so appending
    to arrays costs little even for texts with very many matches.
    """
    none = f"cast(array() as array<{_SPAN}>)"
    start = f"acc.at + length({gaps}[i])"
    block = (f"aggregate(sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size({found})) - 1), struct(0L as at, {none} as spans), "
             f"(acc, i) -> struct({start} + length({found}[i]) as at, concat(acc.spans, array(struct({place} as place, "
             f"'{kind}' as kind, {start} as start, {start} + length({found}[i]) as stop, {found}[i] as value, "
             f"right({gaps}[i], {NEAR_CHARS}) as before, left({gaps}[i + 1], {NEAR_CHARS}) as after))) as spans))")
    shifted = ("transform(x.spans, s -> struct(s.place as place, s.kind as kind, s.start + acc.at as start, s.stop + acc.at as stop, "
               "s.value as value, s.before as before, s.after as after))")
    return (f"case when size({found}) > 0 then flatten(aggregate("
            f"transform(sequence(0, cast((size({found}) - 1) div {BLOCK} as int)), b -> {block}), "
            f"struct({origin} as at, cast(array() as array<array<{_SPAN}>>) as parts), "
            f"(acc, x) -> struct(acc.at + x.at as at, concat(acc.parts, array({shifted})) as parts), acc -> acc.parts)) "
            f"else {none} end")


def _located(df: DataFrame, text: str, pattern: str, found: str, gaps: str) -> DataFrame:
    """The matches of a pattern and the text between them."""
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, held): one row per document, valid spans of all kinds by start, then kind.

    ``held`` is the text where there are spans, so that it needn't be looked up again.
    """
    df = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"),
                     F.coalesce("text", F.lit("")).alias("text"))
    for i, (_, pattern) in enumerate(KINDS):
        df = _located(df, "text", pattern, f"found{i}", f"gaps{i}")
    valid = [f"filter({_spans(i, kind, f'found{i}', f'gaps{i}')}, x -> {_VALID[kind]})" for i, (kind, _) in enumerate(KINDS)]
    order = "case when a.start < b.start then -1 when a.start > b.start then 1 else a.place - b.place end"
    return (df.select("doc_id", "text_hash", F.expr(f"array_sort(concat({', '.join(valid)}), (a, b) -> {order})").alias("spans"), "text")
            .select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("held")))


def _words(text: str) -> str:
    """SQL for the lower-case words of a text, in order."""
    return f"transform(regexp_extract_all({text}, '{TERM}', 0), w -> lower(w))".replace("\\", "\\\\")


def _with_replaced(df: DataFrame, out: str, text: str, spans: str, label: str) -> DataFrame:
    """``df`` with ``out``: the text with its ``spans``, sorted by start, replaced by ``label`` of the span s; overlapping ones become one.

    The text is cut into parts of PART code points, so that no piece between two spans is looked for from the
    start of the text, and the pieces are joined once: time and memory grow with the text, however many spans it has.
    """
    cut = "struct<since:bigint,until:bigint,label:string>"
    # within BLOCK spans: the text before each one that starts after all that end before it
    block = (f"aggregate(slice({spans}, b * {BLOCK} + 1, {BLOCK}), struct(acc.at as at, cast(array() as array<{cut}>) as cuts), (x, s) -> "
             f"struct(greatest(x.at, s.stop) as at, case when s.start >= x.at then concat(x.cuts, array(struct(x.at as since, s.start as until, "
             f"{label} as label))) else x.cuts end as cuts))")
    cuts = (f"aggregate(sequence(0, cast((size({spans}) - 1) div {BLOCK} as int)), struct(0L as at, cast(array() as array<array<{cut}>>) as parts), "
            f"(acc, b) -> element_at(transform(array({block}), r -> struct(r.at as at, concat(acc.parts, array(r.cuts)) as parts)), 1))")

    def piece(since: str, until: str) -> str:
        first, last = f"cast({since} div {PART} as int)", f"cast(({until} - 1) div {PART} as int)"
        return (f"case when {since} >= {until} then '' "
                f"when {first} = {last} then substring(_parts[{first}], cast({since} % {PART} + 1 as int), cast({until} - {since} as int)) "
                f"else concat(substring(_parts[{first}], cast({since} % {PART} + 1 as int)), "
                f"array_join(slice(_parts, {first} + 2, {last} - {first} - 1), ''), "
                f"substring(_parts[{last}], 1, cast({until} - {PART} * {last} as int))) end")
    df = df.withColumns({"_parts": F.expr(f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"), "_cuts": F.expr(cuts)})
    return df.withColumn(out, F.expr(
        f"array_join(concat(flatten(transform(flatten(_cuts.parts), c -> array({piece('c.since', 'c.until')}, c.label))), "
        f"array({piece('_cuts.at', f'cast(length({text}) as bigint)')})), '')")).drop("_parts", "_cuts")


def _contexts(found: DataFrame) -> DataFrame:
    """(row, entity, context, term): words near each span.

    Near means among the closest NEAR_WORDS whole words within NEAR_CHARS characters on either side,
    up to the next span of the same kind.
    """
    spans = found.where(F.size("spans") > 0).select("row", F.inline("spans"))
    spans = spans.withColumn("entity", F.concat("kind", F.lit(":"), F.lower("value")))
    spans = spans.withColumn("context", F.xxhash64("before", "after"))
    for side in ("before", "after"):
        spans = _located(spans, side, TERM, f"words_{side}", f"rest_{side}")
    spans = spans.withColumn("origin", F.col("start") - F.length("before"))
    # a word that touches the cut of a full-length context may be the rest of a longer one
    before = _spans(0, "term", "words_before", "rest_before", "origin")
    after = _spans(0, "term", "words_after", "rest_after", "stop")
    spans = spans.withColumn("terms", F.expr(
        f"concat(slice(reverse(filter({before}, x -> x.start > origin or length(before) < {NEAR_CHARS})), 1, {NEAR_WORDS}), "
        f"slice(filter({after}, x -> x.stop < stop + {NEAR_CHARS}), 1, {NEAR_WORDS}))"))
    near = spans.select("row", "entity", "context", F.explode("terms").alias("t"))
    return near.select("row", "entity", "context", F.lower("t.value").alias("term"))


def _outside(found: DataFrame) -> DataFrame:
    """(row, term, passage): the different words outside base spans of every document that has such spans.

    ``passage`` stands for the PASSAGE_WORDS words on either side, the least where a word repeats.
    """
    rest = _with_replaced(found.where(F.size("spans") > 0).select("row", "spans", "held"), "rest", "held", "spans", "' '")
    words = rest.select("row", F.expr(_words("rest")).alias("words"))
    around = (f"transform(words, (w, i) -> struct(w as term, xxhash64(slice(words, greatest(i - {PASSAGE_WORDS}, 0) + 1, "
              f"least(i, {PASSAGE_WORDS}) + 1 + {PASSAGE_WORDS})) as passage))")
    return words.select("row", F.explode(F.expr(around)).alias("w")).groupBy("row", "w.term").agg(F.min("w.passage").alias("passage"))


def disclosures(texts: DataFrame, found: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, ratio): pairs at or over the lower threshold. Counts are over all documents."""
    outside = table_of(_outside(found), "outside")
    held = (found.where(F.size("spans") > 0).select("row", F.inline("spans"))
            .select("row", F.concat("kind", F.lit(":"), F.lower("value")).alias("entity")).distinct())
    entities = table_of(held.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")), "entities")
    total = found.agg(F.count(F.lit(1)).alias("n"))
    # an inner join stays above the counting; a semi join would be pushed below it, onto every word of every document
    terms = table_of(texts.select(F.explode(F.array_distinct(F.expr(_words("text")))).alias("term"))
                     .groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
                     .join(outside.select("term").distinct(), "term"), "terms")
    near = (_contexts(found).join(outside.select("row", "term"), ["row", "term"])
            .groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support))
    # both are in at most df(e) documents, so a word over this bound can't reach the threshold with e
    most = F.pow("n", F.lit(1.0 - generalise)) * F.pow("with_entity", F.lit(float(generalise))) * 1.000001
    repeated = entities.where(F.col("with_entity") >= support).crossJoin(total).select("entity", most.alias("most"))
    widest = repeated.agg(F.max("most").alias("widest"))
    rare = (outside.join(terms.where(F.col("with_term") >= support).crossJoin(widest).where(F.col("with_term") <= F.col("widest")), "term")
            .select("row", "term", "passage", "with_term"))
    together = (rare.join(held.join(repeated, "entity"), "row").where(F.col("with_term") <= F.col("most"))
                .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.countDistinct("passage").alias("passages")))
    # a pair that is not among these is in one document, or its word is over the bound
    pairs = (together.join(near, ["entity", "term"], "full")
             .where((F.col("passages") >= support) | F.col("contexts").isNotNull())
             .select("entity", "term", F.coalesce("both", F.lit(1)).alias("both")))
    ratio = F.try_divide(F.log2(F.col("n") * F.col("both") / (F.col("with_entity") * F.col("with_term"))),
                         F.log2(F.col("n") / F.col("with_entity")))
    return (pairs.join(entities, "entity").join(terms, "term").crossJoin(total)
            .select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= generalise))


def find(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text_hash, base, terms): the spans of every document.

    ``base`` is the array of base spans, ``terms`` that of disclosing words as (start, stop, label):
    every occurrence outside base spans, in any document, of a word that discloses some entity.
    A null text is empty, a null doc_id stays null, repeated rows each keep
    their row, an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")
    texts = docs.select(ident, F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    found = table_of(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans").withColumn("id", ident)
    verdicts = table_of(disclosures(texts, found, generalise, support).groupBy("term").agg(F.max("ratio").alias("ratio")), "verdicts")
    key = ["id", "text_hash"]
    # texts in parts that end where a word does: a word is looked for in its part only
    cut = f"regexp_extract_all(text, '(?s).{{1,{TERM_PART}}}{TERM[:-2]}*+', 0)".replace("\\", "\\\\")
    starts = _spans(0, "part", "parts", "none")
    parts = texts.withColumn("parts", F.expr(cut)).withColumn("none", F.expr("transform(sequence(0, size(parts)), i -> '')"))
    parts = parts.select(*key, F.posexplode(F.expr(f"transform({starts}, x -> struct(x.start as origin, x.value as part))"))).select(
        *key, F.col("pos").alias("nth"), "col.origin", "col.part")
    # each part's disclosing words, as it writes them; they are letters, marks and digits, and so patterns of themselves
    forms = parts.select(*key, "nth", F.explode(F.array_distinct(F.regexp_extract_all("part", F.lit(TERM), F.lit(0)))).alias("word"))
    label = F.when(F.col("ratio") >= remove, "[REMOVED]").when(F.col("word").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    hits = table_of(forms.withColumn("term", F.lower("word")).join(verdicts, "term").select(*key, "nth", "word", label.alias("label")).distinct()
                    .groupBy(*key, "nth").agg(F.collect_list("word").alias("told"), F.map_from_entries(F.collect_list(F.struct("word", "label")))
                                              .alias("labels")), "hits")
    # by merging at every size: with a small table of hits the plan would be another one than at scale
    words = parts.join(hits.hint("merge"), [*key, "nth"]).withColumn("pattern", F.concat(F.lit(APART[0]), F.array_join("told", "|"), F.lit(APART[1])))
    words = words.withColumn("words", F.expr("regexp_extract_all(part, pattern, 0)")).withColumn("rest", F.expr("split(part, pattern, -1)"))
    terms = words.select(*key, F.explode(F.expr(f"transform({_spans(0, 'term', 'words', 'rest', 'origin')}, x -> struct(x.start as start, "
                                                "x.stop as stop, labels[x.value] as label))")).alias("t")).select(*key, "t.*")
    # base spans by the stretches of text that they touch, so that terms and spans of a long text meet in theirs only
    held = found.where(F.size("spans") > 0).select(*key, F.inline(F.expr("transform(spans, s -> struct(s.start as since, s.stop as until))")))
    held = held.select("*", F.explode(F.expr(f"sequence(since div {PART}, (until - 1) div {PART})")).alias("stretch")).distinct()
    apart = (terms.select("*", F.explode(F.expr(f"sequence(start div {PART}, (stop - 1) div {PART})")).alias("stretch"))
             .join(held, [*key, "stretch"], "left")
             .groupBy(*key, "start", "stop", "label").agg(F.count(F.when((F.col("since") < F.col("stop")) & (F.col("start") < F.col("until")), 1))
                                                         .alias("within")).where("within = 0"))
    spans = apart.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "label"))).alias("terms"))
    return found.join(spans, key, "left").select("doc_id", "text_hash", F.col("spans").alias("base"), F.coalesce(
        "terms", F.expr("cast(array() as array<struct<start:bigint,stop:bigint,label:string>>)")).alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans and all spans as text."""
    as_text = "concat(x.kind, ':', x.start, ':', x.stop)"
    every = ("array_sort(concat(transform(base, x -> struct(x.start as start, x.place as place, x.stop as stop, x.kind as kind)), "
             "transform(terms, x -> struct(x.start as start, 9 as place, x.stop as stop, 'term' as kind))))")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, _ in KINDS],
        F.sha2(F.expr(f"array_join(transform(base, x -> {as_text}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform({every}, x -> {as_text}), ',')").alias("spans"))


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with every span of its texts replaced by its label; overlapping spans become one.

    The spans of a text depend on the text alone, so they are joined on doc_id and a hash of it.
    ``n_chars``, where there is such a column, is renewed for changed texts.
    """
    label = "case x.kind " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " end"
    spans = find(docs, **thresholds).where((F.size("base") > 0) | (F.size("terms") > 0)).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash",
        F.expr(f"array_sort(concat(transform(base, x -> struct(x.start as start, x.stop as stop, {label} as label)), terms))").alias("spans"))
    spans = spans.dropDuplicates(["id", "text_hash"])
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                        F.xxhash64("text").alias("text_hash"))
    both = _with_replaced(keyed.join(spans, ["id", "text_hash"], "left").withColumn("_text", F.when(F.col("spans").isNotNull(), F.col("doc.text"))),
                          "_new", "_text", "spans", "s.label")
    changed = F.col("doc").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("_new").cast(docs.schema["n_chars"].dataType))
    return both.select(F.when(F.col("spans").isNull(), F.col("doc")).otherwise(changed).alias("doc")).select("doc.*")
