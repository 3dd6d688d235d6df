"""Every operator as a query over the driver's tables, with DuckDB SQL for the same rows.

Texts are all documents and the fixture texts; writers are the documents' sources, and the fixtures'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.functions.numbers import rounded
from idiolect.operators import calibration as cal
from idiolect.operators import metrics as m
from idiolect.operators import contexts, profile, render, scoring, vocabulary
from idiolect.operators.features import FEATURES, analyse, long_form
from idiolect.operators.features import features as feature_rows
from idiolect.plans import fixtures as fx
from idiolect.plans import oracle as o
from idiolect.sources import evidence, files
from idiolect.sources.scratch import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql_list(items: Iterable[str]) -> str:
    return "[" + ", ".join(map(fx.quoted, items)) + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is dealt over them; a large one is left as it is, without a shuffle. To be
    called on the table itself: a union with fixtures has the fixtures' partitions too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.frame(spark, [(fx.BASE_ID + i, t) for i, t in enumerate(fx.TEXTS)], "doc_id long, text string")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(own)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.measured(tx.normalised(texts(spark, sf_dir)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """writer, seq, context, text: documents by source, and the fixtures' writers."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("writer"), F.col("doc_id").alias("seq"), F.col("lang").alias("context"), "text")
    return spread(docs).unionByName(fx.frame(spark, fx.SAMPLES, "writer string, seq long, context string, text string"))


FIXTURE_SAMPLES = fx.values(fx.SAMPLES, "writer, seq, context, text")
SAMPLES = rf"""select writer, seq, nullif(regexp_replace(regexp_replace(lower(context), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '') as context, text from
  (select source as writer, doc_id as seq, lang as context, text from documents union all select * from {FIXTURE_SAMPLES}) where {o.strip("coalesce(text, '')")} <> ''"""


# --- inputs of the queries about people: labels stand for what they were asked and chose -----------------------------

_EVERY = cal.ONBOARDING + cal.CALIBRATION
_ASKED = f"""select doc_id::varchar as writer, doc_id as seq, {_sql_list([q.id for q in _EVERY])}[(doc_id + 3 * coalesce(quality, 0) + 5 * coalesce(toxic, 0)) % {len(_EVERY)} + 1] as question_id from labels
  union all select * from {fx.values(fx.ASKED, 'writer, seq, question_id')}"""
_PAIR = f"doc_id % {len(cal.PAIRS)} + 1"
_OWN_CHOICES = f"""select 'w' || (doc_id % 40) as writer, doc_id as seq, {_sql_list([i for i, _, _ in cal.PAIRS])}[{_PAIR}] as pair_id, {_sql_list([f for _, f, _ in cal.PAIRS])}[{_PAIR}] as formal,
  {_sql_list([p for _, _, p in cal.PAIRS])}[{_PAIR}] as plain, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic from labels"""
_VERDICTS = f"""(select writer, seq, formal, plain, case when toxic = 1 then null when quality = 1 then plain else formal end as chosen from ({_OWN_CHOICES}) union all select * from {fx.values(fx.VERDICTS, 'writer, seq, formal, plain, chosen')})"""
_CHOICES = f"""(select writer, seq, pair_id, case when toxic = 1 then ' Neither' when quality = 1 then upper(plain) else formal || ' ' end as answer from ({_OWN_CHOICES}) union all select * from {fx.values(fx.CHOICES, 'writer, seq, pair_id, answer')})"""
_VOCABULARIES = f"""(select writer, list_sort(list_distinct(coalesce(list(formal) filter (where quality = 1), []))) as avoid, list_sort(list_distinct(coalesce(list(formal) filter (where toxic = 1), []))) as confirmed from ({_OWN_CHOICES}) group by writer
  union all select * from {fx.values(fx.VOCABULARIES, 'writer, avoid, confirmed')})"""
_ASKED_PAIRS = f"(select distinct writer, pair_id from ({_OWN_CHOICES}) where toxic = 0 union all select * from {fx.values(fx.ASKED_PAIRS, 'writer, pair_id')})"
_DOC_STYLES = f"with {o.analysed(o.TEXTS)} " + " union all ".join(
    f"select doc_id::varchar as writer, '{d.name}' as dimension, round_even(greatest(0e0, least(100e0, {o.raw_score(d)})), 0)::integer as value, {o.rounded(f'least({d.ceiling!r}::double, {d.ceiling!r}::double * (case when words > 0 then least(1e0, words / {float(d.words)!r}::double) else 0e0 end) * {scoring.SINGLE!r}::double)', 2)} as confidence from f"
    for d in scoring.DIMENSIONS
)
_STYLE_ROWS = f"(select * from ({_DOC_STYLES}) union all select writer, dimension, value, confidence::double from {fx.values(fx.STYLES, 'writer, dimension, value, confidence')})"


def _pick(items: Iterable[str], place) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), place.cast("int") + 1)


def asked(spark, sf_dir):
    """writer, seq, question_id: a labelled document's writer answered one question, by its id and labels."""
    q, t = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("writer"), F.col("doc_id").alias("seq"), _pick([x.id for x in _EVERY], (F.col("doc_id") + 3 * q + 5 * t) % len(_EVERY)).alias("question_id"))
    return own.unionByName(fx.frame(spark, fx.ASKED, "writer string, seq long, question_id string"))


def own_choices(spark, sf_dir):
    """writer, seq, pair_id, formal, plain, quality, toxic: forty writers met a pair of words for each labelled document."""
    place = F.col("doc_id") % len(cal.PAIRS)
    of = lambda k: _pick([p[k] for p in cal.PAIRS], place)
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("w"), (F.col("doc_id") % 40).cast("string")).alias("writer"), F.col("doc_id").alias("seq"), of(0).alias("pair_id"), of(1).alias("formal"), of(2).alias("plain"), F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def verdicts(spark, sf_dir):
    chosen = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, F.col("plain")).otherwise(F.col("formal"))
    own = own_choices(spark, sf_dir).select("writer", "seq", "formal", "plain", chosen.alias("chosen"))
    return own.unionByName(fx.frame(spark, fx.VERDICTS, "writer string, seq long, formal string, plain string, chosen string"))


def choices(spark, sf_dir):
    answer = F.when(F.col("toxic") == 1, " Neither").when(F.col("quality") == 1, F.upper("plain")).otherwise(F.concat("formal", F.lit(" ")))
    own = own_choices(spark, sf_dir).select("writer", "seq", "pair_id", answer.alias("answer"))
    return own.unionByName(fx.frame(spark, fx.CHOICES, "writer string, seq long, pair_id string, answer string"))


def vocabularies(spark, sf_dir):
    """writer, avoid, confirmed: at most a word a pair."""
    words = lambda label: F.array_sort(F.collect_set(F.when(F.col(label) == 1, F.col("formal"))))
    own = own_choices(spark, sf_dir).groupBy("writer").agg(words("quality").alias("avoid"), words("toxic").alias("confirmed"))
    return own.unionByName(fx.frame(spark, fx.VOCABULARIES, "writer string, avoid array<string>, confirmed array<string>"))


def asked_pairs(spark, sf_dir):
    own = own_choices(spark, sf_dir).where("toxic = 0").select("writer", "pair_id").distinct()
    return own.unionByName(fx.frame(spark, fx.ASKED_PAIRS, "writer string, pair_id string"))


def document_styles(spark, sf_dir):
    """writer, dimension, value, confidence: every text as the one sample of a writer of its own."""
    from idiolect.functions.numbers import whole

    rows, words = feature_rows(texts(spark, sf_dir), ["doc_id"]), F.col("word_count")
    confidence = lambda d: rounded(F.least(F.lit(d.ceiling), d.ceiling * scoring.coverage(words, d) * scoring.SINGLE), 2)
    each = F.array(*(F.struct(F.lit(d.name).alias("dimension"), whole(scoring.clamped(scoring.raw_score(d))).alias("value"), confidence(d).alias("confidence")) for d in scoring.DIMENSIONS))
    return rows.select(F.col("doc_id").cast("string").alias("writer"), F.inline(each))


def styles(spark, sf_dir):
    """The documents' styles and the fixtures', written down: several reads, one analysis."""
    return cut(document_styles(spark, sf_dir).unionByName(fx.frame(spark, fx.STYLES, "writer string, dimension string, value int, confidence double")), "styles")


def writers(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("writer"))
    return own.unionByName(fx.frame(spark, [(str(fx.BASE_ID + i),) for i in range(len(fx.TEXTS))] + fx.WRITERS, "writer string"))


# --- sources -----------------------------------------------------------------------------------------------------


_TAILS = ("", ":Work Notes", ":", ":a/b", ": x ")


@query(f"with v as (select url || {_sql_list(_TAILS)}[page_id % {len(_TAILS)} + 1] as value from pages union all select * from {fx.values(fx.ARGUMENTS, 'value')}) select value, case when regexp_matches(value, '^.+:[^/:\\\\]+$') then regexp_extract(value, '^(.+):([^/:\\\\]+)$', 1) else value end as path, case when regexp_matches(value, '^.+:[^/:\\\\]+$') then nullif(regexp_replace(lower(trim(regexp_extract(value, '^(.+):([^/:\\\\]+)$', 2))), '\\s+', '-', 'g'), '') end as label from v")
def sample_arguments(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.concat("url", _pick(_TAILS, F.col("page_id") % len(_TAILS))).alias("value"))
    return own.unionByName(fx.frame(spark, fx.ARGUMENTS, "value string")).select("value", F.inline(F.array(tx.sample_argument(F.col("value")))))


@query("select event_id, k as question_id, json_extract_string(props, '$.\"' || k || '\"') as answer from events, unnest(json_keys(props::json)) as u(k)")
def json_answers(spark, sf_dir):
    return files.answers(table(spark, sf_dir, "events").select("event_id", "props"), "props")


_LINES = f"""select case doc_id % 5 when 4 then substr(line, 1, length(line) - 3) when 3 then replace(line, '"source"', '"origin"') else line end as value
  from (select doc_id, '{{"id":"writ_' || doc_id || '","kind":"writing_sample","source":"' || source || '","timestamp":"2024-01-01T00:00:00+00:00","word_count":' || length(coalesce(text, '')) || ',"text_ref":"samples/' || doc_id || '.txt","meta":{{"context":"' || lang || '"}}}}' as line from documents)
  union all select * from {fx.values(fx.LOG, 'value')}"""


@query(f"""with p as (select value, try_cast(value as json) as j from ({_LINES}) where trim(value) <> '')
select j->>'$.id' as id, j->>'$.kind' as kind, j->>'$.source' as source, (j->>'$.word_count')::bigint as word_count, j->>'$.text_ref' as text_ref, j->>'$.meta.context' as context, j->>'$.meta.formal' as formal
from p where json_type(j) = 'OBJECT' and j->>'$.id' is not null and j->>'$.timestamp' is not null and j->>'$.kind' is not null and j->>'$.source' is not null and j->>'$.word_count' is not null""")
def evidence_log(spark, sf_dir):
    """Documents as lines of the log; of five, one line is cut off and one lacks a field."""
    ref = F.concat(F.lit("samples/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    line = F.to_json(F.struct(
        F.concat(F.lit("writ_"), F.col("doc_id").cast("string")).alias("id"), F.lit("writing_sample").alias("kind"), "source", F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"),
        F.length(F.coalesce("text", F.lit(""))).alias("word_count"), ref.alias("text_ref"), F.struct(F.col("lang").alias("context")).alias("meta"),
    ))
    broken = F.when(F.col("doc_id") % 5 == 4, F.expr("substr(line, 1, length(line) - 3)")).when(F.col("doc_id") % 5 == 3, F.replace("line", F.lit('"source"'), F.lit('"origin"'))).otherwise(F.col("line"))
    lines = table(spark, sf_dir, "documents").withColumn("line", line).select(broken.alias("value")).unionByName(fx.frame(spark, fx.LOG, "value string"))
    return evidence.parsed(lines).select("id", "kind", "source", "word_count", "text_ref", F.col("meta.context").alias("context"), F.col("meta.formal").alias("formal"))


_TYPED = f"""t as (select doc_id, text from documents where text is not null union all select * from {fx.values(fx.TYPED, 'doc_id, text')}),
l as (select doc_id, i - 1 as n, x[i] as line, {o.strip('x[i]')} as bare from (select doc_id, string_split(text, chr(10)) as x from t), unnest(range(1, len(x) + 1)) as u(i)),
a as (select *, last_value(case when bare <> '' then n end ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding) as filled from l),
e as (select doc_id, n, line, 'answer' as kind, bare = '' and (n - coalesce(filled, -1)) % 2 = case when filled is null then 0 else 1 end as ends from a union all select doc_id, n, line, 'paste', bare = '.' from l),
k as (select *, coalesce(sum(ends::integer) over (partition by doc_id, kind order by n rows between unbounded preceding and 1 preceding), 0)::bigint as entry from e),
g as (select doc_id, kind, entry, {o.strip("coalesce(string_agg(line, chr(10) order by n) filter (where not ends), '')")} as text from k group by 1, 2, 3)"""


@query(f"with {_TYPED} select doc_id, kind, entry, length(text)::bigint as chars, sha256(text) as text_sha256 from g")
def typed_entries(spark, sf_dir):
    """Documents as what somebody types, read as answers and as pastes."""
    own = fx.frame(spark, fx.TYPED, "doc_id long, text string")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")).unionByName(own)
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    read = lambda kind, paste: files.entered(lines, ["doc_id"], paste).withColumn("kind", F.lit(kind))
    both = read("answer", False).unionByName(read("paste", True))
    return both.select("doc_id", "kind", "entry", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@query("select doc_id, 'writ_' || substr(sha256('writing_sample:' || doc_id || ':' || text), 1, 12) as id from documents")
def evidence_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evidence.new_id(F.col("text"), F.lit("writing_sample"), F.col("doc_id")).alias("id"))


@query("select l.doc_id, 'q' || quality as context, length(text) as chars from labels l join documents d on l.doc_id = d.doc_id")
def evidence_join_samples(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("samples/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("text_ref"), F.struct(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("context")).alias("meta"))
    stored = table(spark, sf_dir, "documents").select(F.concat(F.lit("samples/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("text_ref"), "text")
    return evidence.labelled_samples(log, stored).select("doc_id", "context", F.length("text").cast("long").alias("chars"))


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def samples_without_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""with v as (select * from {_CHOICES}), p as (select * from {fx.values([(i, f, q) for i, f, q in cal.PAIRS], 'pair_id, formal, plain')})
select writer, seq, v.pair_id, formal, plain, case when lower(trim(answer)) in ('neither', 'n', 'none') then null else lower(trim(answer)) end as chosen from v join p on v.pair_id = p.pair_id""")
def scripted_choices(spark, sf_dir):
    return cal.scripted_choices(choices(spark, sf_dir))


@query(f"""with v as (select * from {_CHOICES}), p as (select * from {fx.values([(i, f, q) for i, f, q in cal.PAIRS], 'pair_id, formal, plain')}),
c as (select writer, seq, v.pair_id, case when lower(trim(answer)) in ('neither', 'n', 'none') then 'neither' else lower(trim(answer)) end as picked from v join p on v.pair_id = p.pair_id)
select 'cali_' || substr(sha256('calibration_choice:' || seq || ':' || pair_id || ':' || picked), 1, 12) as id, pair_id as source, nullif(picked, 'neither') as chosen from c""")
def choice_records(spark, sf_dir):
    rows = evidence.choice_records(scripted_choices(spark, sf_dir), F.lit("2024-01-01T00:00:00+00:00"))
    return rows.select("id", "source", F.col("meta.chosen").alias("chosen"))


@query(f"""with v as (select * from {_CHOICES}), p as (select * from {fx.values([(i, f, q) for i, f, q in cal.PAIRS], 'pair_id, formal, plain')})
select writer, seq, formal, plain, case when lower(trim(answer)) in ('neither', 'n', 'none') then null else lower(trim(answer)) end as chosen from v join p on v.pair_id = p.pair_id""")
def logged_verdicts(spark, sf_dir):
    """Choices as records of the log, and read from it again."""
    records = evidence.choice_records(scripted_choices(spark, sf_dir), F.lit("2024-01-01T00:00:00+00:00"))
    return evidence.verdicts(records).select("writer", "seq", "formal", "plain", "chosen")


# --- normalising and segmenting ----------------------------------------------------------------------------------


@query(f"with {o.base(o.TEXTS)} select doc_id, sha256(norm) as norm_sha256, length(norm)::bigint as text_length from b")
def normalise(spark, sf_dir):
    return tx.normalised(texts(spark, sf_dir)).select("doc_id", F.sha2("norm", 256).alias("norm_sha256"), F.length("norm").cast("long").alias("text_length"))


@query(f"with {o.base(o.TEXTS)} select doc_id, words::bigint as word_count, sha256(array_to_string(tokens, ' ')) as tokens_sha256 from b")
def tokens_count(spark, sf_dir):
    rows = tx.normalised(texts(spark, sf_dir)).select("doc_id", tx.tokens(F.col("norm")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("word_count"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"with {o.base(o.TEXTS)} select doc_id, (i - 1)::integer as pos, paragraphs[i] as paragraph from b, unnest(range(1, len(paragraphs) + 1)) as u(i)")
def paragraph_split(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", F.posexplode("paragraphs").alias("pos", "paragraph"))


@query(f"with {o.base(o.TEXTS)} select doc_id, (i - 1)::integer as pos, sentences[i] as sentence, len(st[i])::integer as words from b, unnest(range(1, len(sentences) + 1)) as u(i)")
def sentence_split(spark, sf_dir):
    rows = measured(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip("sentences", "sentence_tokens")).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.col("s.sentences").alias("sentence"), F.size("s.sentence_tokens").alias("words"))


@query(f"with {o.base(o.TEXTS)} select doc_id, len(lines)::bigint as n_lines, {o.BASIC['heading_count']}::bigint as n_headings, {o.BASIC['bullet_count']}::bigint as n_bullets from b")
def line_kinds(spark, sf_dir):
    rows = tx.normalised(texts(spark, sf_dir)).select("doc_id", tx.lines(F.col("norm")).alias("l"))
    n = lambda f: F.size(F.filter("l", f)).cast("long")
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), n(tx.is_heading).alias("n_headings"), n(tx.is_bullet).alias("n_bullets"))


@query(f"select context, count(*) as n from ({SAMPLES}) group by context")
def context_labels(spark, sf_dir):
    return profile.usable(samples(spark, sf_dir)).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


@query(rf"select doc_id, case when {o.strip('x')} = '' then 0 else len(regexp_split_to_array({o.strip('x')}, '\s+')) end::integer as n from (select doc_id, {o.norm('text')} as x from ({o.TEXTS}))")
def blank_words(spark, sf_dir):
    return tx.normalised(texts(spark, sf_dir)).select("doc_id", tx.blank_words(F.col("norm")).alias("n"))


# --- metrics -----------------------------------------------------------------------------------------------------


def cast(names, kind: str) -> str:
    return ", ".join(f"{n}::{kind} as {n}" for n in names)


_WHOLE = [k for k in o.BASIC if k.endswith("count")]
_REAL = [k for k in o.BASIC if not k.endswith("count")]


@query(f"with {o.base(o.TEXTS)}, c as (select doc_id, {o.columns(o.BASIC)} from b) select doc_id, {cast(_WHOLE, 'bigint')}, {', '.join(_REAL)} from c")
def basic_metrics(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in m.basic().items() if k != "sentence_lengths"))


@query(f"with {o.base(o.TEXTS)}, {o.mtld('b', 'doc_id')} select doc_id, vocabulary_diversity from mt")
def mtld(spark, sf_dir):
    return m.with_mtld(tx.normalised(texts(spark, sf_dir)).select("doc_id", "norm")).select("doc_id", "vocabulary_diversity")


@query(ORACLE_SQL["mtld"])
def mtld_in_sql(spark, sf_dir):
    """mtld without Python, over the same texts."""
    return tx.normalised(texts(spark, sf_dir)).select("doc_id", m.mtld_expression(tx.tokens(F.col("norm"))).alias("vocabulary_diversity"))


@query(f"with {o.base(o.TEXTS)} select doc_id, (i - 1)::integer as pos, lengths[i]::integer as words from b, unnest(range(1, len(lengths) + 1)) as u(i)")
def sentence_lengths(spark, sf_dir):
    """The words of each sentence that has any."""
    return measured(spark, sf_dir).select("doc_id", F.posexplode(m.basic()["sentence_lengths"]).alias("pos", "words"))


def _bands() -> str:
    rows = []
    for k in m.MARKS:
        rare, occasional = m.BANDS[k]
        rows.append(f"case when n_{k} = 0 then 'never' when rate_{k} <= {rare} then 'rare' when rate_{k} <= {occasional} then 'occasional' else 'frequent' end as band_{k}")
    return ", ".join(rows)


@query(f"""with {o.base(o.TEXTS)}, c as (select doc_id, words, {o.columns({f'n_{k}': v for k, v in o.MARKS.items()})} from b),
d as (select *, {o.columns({f'rate_{k}': o.rate(f'n_{k}', 'words', 1000) for k in m.MARKS})} from c)
select doc_id, {cast([f'n_{k}' for k in m.MARKS], 'bigint')}, {', '.join(f'rate_{k}' for k in m.MARKS)}, {_bands()} from d""")
def punctuation(spark, sf_dir):
    rows = m.measured(tx.normalised(texts(spark, sf_dir))).withColumn("word_count", F.size("tokens"))
    return m.punctuation(rows).select("doc_id", *(f"{p}_{k}" for p in ("n", "rate", "band") for k in m.MARKS))


@query(f"with {o.base(o.TEXTS)}, c as (select *, {o.columns(o.SYNTAX)} from b) select doc_id, {cast(o.SYNTAX, 'bigint')}, {o.columns(o.SYNTAX_RATES)} from c")
def syntax_metrics(spark, sf_dir):
    return m.syntax(measured(spark, sf_dir)).select("doc_id", *o.SYNTAX, *o.SYNTAX_RATES)


@query(f"with {o.base(o.TEXTS)}, c as (select *, {o.columns(o.VOCABULARY)} from b) select doc_id, {cast(o.VOCABULARY, 'bigint')}, {o.columns(o.VOCABULARY_RATES)} from c")
def vocabulary_rates(spark, sf_dir):
    return m.vocabulary(measured(spark, sf_dir)).select("doc_id", *o.VOCABULARY, *o.VOCABULARY_RATES)


@query(f"with {o.base(o.TEXTS)} " + " union all ".join(f"select '{k}' as shape, lower(x) as term, count(*) as n from b, unnest({v}) as u(x) group by 2" for k, v in o.SHAPES.items()))
def technical_shapes(spark, sf_dir):
    found = {k: F.transform(m.shapes_found(F.col("norm"), k), F.lower) for k in m.SHAPES}
    found["acronym"] = F.filter(found["acronym"], lambda x: ~tx.one_of(x, lex.STOPWORDS))
    found["code"] = F.array_distinct(found["code"])
    named = lambda k, x: F.transform(x, lambda t: F.struct(F.lit(k).alias("shape"), t.alias("term")))
    every = F.concat(*(named(k, x) for k, x in found.items()))
    return tx.normalised(texts(spark, sf_dir)).select(F.inline(every)).groupBy("shape", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {o.base(o.TEXTS)} select token, count(*) as n from b, unnest(tokens) as u(token) group by token")
def token_freq(spark, sf_dir):
    rows = tx.normalised(texts(spark, sf_dir)).select(F.explode(tx.tokens(F.col("norm"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {o.base(o.TEXTS)} select token, count(*) as n from b, unnest(tokens) as u(token) where token not in {o.lit(lex.STOPWORDS)} and length(token) > 2 group by token")
def content_words(spark, sf_dir):
    rows = tx.normalised(texts(spark, sf_dir)).select(F.explode(tx.tokens(F.col("norm"))).alias("token"))
    return rows.where(vocabulary.content(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select category, count(distinct term) as n_terms, count(*) as n_hits from (with {o.base(o.TEXTS)}, l as (select * from {fx.values(lex.DEFAULT.rows(), 'category, term')})
select category, term from b, unnest(tokens) as u(token) join l on l.term = token) group by category""")
def lexicon_hits(spark, sf_dir):
    rows = tx.normalised(texts(spark, sf_dir)).select(F.explode(tx.tokens(F.col("norm"))).alias("term"))
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # before the join: a row a word
    listed = fx.frame(spark, lex.DEFAULT.rows(), "category string, term string")
    return counted.join(F.broadcast(listed), "term").groupBy("category").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_hits"))


def _lists(key: str = "writer") -> str:
    t = "token"
    word = {
        "common_words": f"{t} not in {o.lit(lex.STOPWORDS)} and length({t}) > 2",
        "technical_terms": f"{t} in {o.lit(lex.TECHNICAL_TERMS)}",
        "colloquialisms": f"{t} in {o.lit(lex.COLLOQUIALISMS)}",
        "filler_words": f"{t} in {o.lit(lex.FILLERS)}",
        "hedging_terms": f"{t} in {o.lit(lex.HEDGE_WORDS)}",
        "buzzwords": f"{t} in {o.lit(lex.BUZZWORDS)}",
        "formal_words": f"{t} in {o.lit(lex.FORMAL_VOCAB)}",
    }
    word["unusual_words"] = f"{word['common_words']} and length({t}) >= 8 and n <= 2 and {t} not in {o.lit(lex.TECHNICAL_TERMS)}"
    word["repeated_words"] = f"{word['common_words']} and n >= 3"
    style = lex.HEDGE_WORDS + lex.FILLERS + lex.COLLOQUIALISMS + lex.INTENSIFIERS + lex.HUMOUR_MARKERS
    word["style_words"] = f"{t} in {o.lit(style)} and {t} not in {o.lit(lex.NUMBER_WORDS + lex.VAGUE_WORDS + lex.CONTRACTIONS)} and not contains({t}, '''') and not regexp_matches({t}, '[0-9]')"
    rows = [f"select {key}, '{k}' as list, token as term, n from freq where {c}" for k, c in word.items()]
    for k, phrases in (("hedging_terms", lex.HEDGE_PHRASES), ("style_phrases", lex.HEDGE_PHRASES), ("colloquialisms", lex.COLLOQUIAL_PHRASES), ("style_phrases", lex.COLLOQUIAL_PHRASES), ("buzzwords", lex.BUZZ_PHRASES)):
        rows.append(f"select {key}, '{k}' as list, p.term, sum(len(regexp_extract_all(lw, p.pattern)))::bigint as n from b, {fx.values([(p, o.phrase(p).replace(chr(39) * 2, chr(39))) for p in phrases], 'term, pattern')} as p where contains(lw, p.term) or regexp_matches(lw, p.pattern) group by 1, 3")
    rows += [f"select {key}, 'technical_terms' as list, lower(x) as term, count(*) as n from b, unnest({v}) as u(x) group by 1, 3" for v in o.SHAPES.values()]
    return " union all ".join(rows)


CORPORA = f"select writer, string_agg(text, chr(10) || chr(10) order by seq) as text from ({SAMPLES}) group by writer"


def term_ctes(key: str) -> str:
    """CTEs freq and terms over b, and tops: a column for each list's first twelve."""
    tops = ", ".join(f"coalesce(string_agg(term, '|' order by rank) filter (where list = '{k}'), '') as {k}" for k in vocabulary.LISTS)
    return f"""freq as (select {key}, token, count(*) as n from b, unnest(tokens) as u(token) group by 1, 2),
terms as (select {key}, list, term, sum(n)::bigint as n from ({_lists(key)}) where n > 0 group by 1, 2, 3),
ranked as (select * from (select *, row_number() over (partition by {key}, list order by n desc, term)::integer as rank from terms) where rank <= 12),
tops as (select {key}, {tops} from ranked group by {key})"""


def recurring_ctes(key: str) -> str:
    """CTEs g (runs of words) and recurring (phrases, as a list) over b."""
    return f"""g as (select {key}, array_to_string(tokens[i:i + k - 1], ' ') as phrase from b, unnest(range(1, words + 1)) as u(i), (values (2), (3), (4)) as v(k) where i + k - 1 <= words and tokens[i] in {o.lit(lex.PHRASE_SEEDS)}),
often as (select {key}, phrase, count(*) as n from g group by 1, 2 having count(*) >= 2),
recurring as (select {key}, list_reduce(list([phrase] order by n desc, phrase), lambda a, x: case when len(a) >= 10 or len(list_filter(a, lambda k: contains(k, x[1]))) > 0 then a else list_concat(a, x) end, []::varchar[]) as phrases from often group by 1)"""


TERMS = f"{o.base(CORPORA, 'writer')}, {term_ctes('writer')}"


def samples_measured(spark, sf_dir):
    return m.measured(tx.normalised(profile.usable(samples(spark, sf_dir)).select("writer", "seq", "text")))


@query(f"with {TERMS} select writer, list, term, n, rank from ranked")
def top_lists(spark, sf_dir):
    return vocabulary.ranked(vocabulary.terms(samples_measured(spark, sf_dir), ["writer"], order="seq"), ["writer"]).select("writer", "list", "term", "n", "rank")


PREFER = f"""with {TERMS}, k as (select writer, term, n, (list = 'style_words')::integer as kind, row_number() over (partition by writer, list order by n desc, term) as rank from terms where list in ('style_words', 'style_phrases')),
s as (select writer, term, row_number() over (partition by writer order by kind, rank) as place from k where n >= 2 and rank <= case when kind = 0 then 6 else 12 end)
select writer, array_to_string(list(term order by place), '|') as prefer from s where place <= 12 group by writer"""


@query(PREFER)
def prefer_list(spark, sf_dir):
    found = vocabulary.prefer(vocabulary.terms(samples_measured(spark, sf_dir), ["writer"], order="seq"), ["writer"])
    return found.select("writer", F.array_join("prefer", "|").alias("prefer"))


def _avoid() -> str:
    plain = [(i, c, (lex.FORMAL_TO_PLAIN.get(c) or "").split(" ")[0] or None) for i, c in enumerate(lex.AVOID_CANDIDATES)]
    return f"""with {o.base(CORPORA, 'writer')}, w as (select writer, lower(norm) as ln, tokens from b where words >= 200),
a as (select writer, i, c from w, {fx.values(plain, 'i, c, p')} as v where not list_contains(tokens, c) and (p is null or list_contains(tokens, p)) qualify row_number() over (partition by writer order by i) <= 8),
q as (select writer, 100 + i as i, c from w, {fx.values(list(enumerate(lex.AVOID_PHRASES)), 'i, c')} as v where not contains(ln, c)),
u as (select *, row_number() over (partition by writer order by i) as k from (select * from a union all select * from q))
select b.writer, coalesce(array_to_string(list(c order by i) filter (where k <= 12), '|'), '') as avoid from b left join u on b.writer = u.writer group by b.writer"""


@query(_avoid())
def avoid_list(spark, sf_dir):
    return vocabulary.avoid(samples_measured(spark, sf_dir), ["writer"]).select("writer", F.array_join("avoid", "|").alias("avoid"))


@query(f"""with {o.base(CORPORA, 'writer')}, g as (select writer, array_to_string(tokens[i:i + k - 1], ' ') as phrase from b, unnest(range(1, words + 1)) as u(i), (values (2), (3), (4)) as v(k) where i + k - 1 <= words and tokens[i] in {o.lit(lex.PHRASE_SEEDS)})
select writer, phrase, count(*) as n from g group by 1, 2""")
def phrase_counts(spark, sf_dir):
    return vocabulary.phrase_counts(samples_measured(spark, sf_dir), ["writer"], order="seq")


@query(f"with {o.base(CORPORA, 'writer')}, {recurring_ctes('writer')} select writer, array_to_string(phrases, '|') as phrases from recurring")
def recurring_phrases(spark, sf_dir):
    found = vocabulary.recurring_phrases(samples_measured(spark, sf_dir), ["writer"], order="seq")
    return found.select("writer", F.array_join("phrases", "|").alias("phrases"))


@query(f"""with {o.analysed(f"select doc_id as seq, source, lang, {o.strip('text')} as text from documents", 'seq, source, lang')},
i as (select *, 'writ_' || substr(sha256('writing_sample:' || seq || ':' || text), 1, 12) as id from (select f.*, src.text from f join src on f.seq = src.seq))
select id, source, 'samples/' || id || '.txt' as text_ref, seq, words::bigint as word_count, sentence_count::bigint as sentence_count, '{{"context":"' || lower(lang) || '"}}' as meta, {o.FEATURE_LIST} from i""")
def sample_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "source", "text", F.col("lang").alias("context"))
    rows = evidence.records(spread(docs), "writing_sample", F.lit("2024-01-01T00:00:00+00:00"))
    return rows.select("id", "source", "text_ref", "seq", "word_count", F.col("metrics.sentence_count").alias("sentence_count"), F.to_json("meta").alias("meta"), *(F.col("metrics.features")[x].alias(x) for x in FEATURES))


_SHOWN = vocabulary.LISTS[:9]


@query(f"""with {o.analysed(o.TEXTS)}, {term_ctes('doc_id')}, {recurring_ctes('doc_id')}
select f.doc_id, words::bigint as word_count, len(lengths)::bigint as sentence_count, unique_word_count::bigint as unique_word_count, contraction_preference, passive_count::bigint as passive_count, n_comma::bigint as n_comma, n_hyphen::bigint as n_hyphen, {o.FEATURE_LIST},
{", ".join(f"coalesce({k}, '') as {k}" for k in _SHOWN)}, coalesce(array_to_string(phrases, '|'), '') as phrases
from f left join tops on f.doc_id = tops.doc_id left join recurring on f.doc_id = recurring.doc_id""")
def metric_dump(spark, sf_dir):
    """The dumps, read again from their JSON."""
    lists = ", ".join(f"{k}: array<string>" for k in _SHOWN)
    kind = f"""basic struct<word_count: bigint, sentence_count: bigint, unique_word_count: bigint>, syntax struct<contraction_preference: double, passive_count: bigint>,
        punctuation struct<counts: map<string, bigint>>, features map<string, double>, vocabulary struct<{lists}>, recurring_phrases array<string>"""
    dumps = files.metric_dump(analyse(texts(spark, sf_dir)), ["doc_id"]).select("doc_id", F.from_json("json", kind).alias("j"))
    return dumps.select(
        "doc_id", "j.basic.*", "j.syntax.*", *(F.col("j.punctuation.counts")[k].alias(f"n_{k}") for k in ("comma", "hyphen")),
        *(F.col("j.features")[x].alias(x) for x in FEATURES), *(F.array_join(f"j.vocabulary.{k}", "|").alias(k) for k in _SHOWN), F.array_join("j.recurring_phrases", "|").alias("phrases"),
    )


# --- scoring -----------------------------------------------------------------------------------------------------


@query(f"with {o.analysed(o.TEXTS)} select doc_id, words::bigint as word_count, {o.FEATURE_LIST} from f")
def features(spark, sf_dir):
    return feature_rows(texts(spark, sf_dir), ["doc_id"]).select("doc_id", "word_count", *FEATURES)


@query(f"with {o.analysed(o.TEXTS)} " + " union all ".join(f"select doc_id, '{x}' as feature, {o.rounded(o.linear(x, *scoring.RANGES[x]), 6)} as mapped from f" for x in FEATURES))
def linear_map(spark, sf_dir):
    rows = feature_rows(texts(spark, sf_dir), ["doc_id"])
    mapped = rows.select("doc_id", *(rounded(scoring.linear_map(F.col(x), *scoring.RANGES[x]), 6).alias(x) for x in FEATURES))
    return long_form(mapped, ["doc_id"]).withColumnRenamed("value", "mapped")


@query(f"with {o.analysed(o.TEXTS)} " + " union all ".join(f"select doc_id, '{d.name}' as dimension, '{x}' as feature, {o.contribution(x, w)} as contribution from f" for d in scoring.DIMENSIONS for x, w in d.weights))
def dimension_contributions(spark, sf_dir):
    rows = feature_rows(texts(spark, sf_dir), ["doc_id"])
    every = F.array(*(F.struct(F.lit(d.name).alias("dimension"), F.lit(x).alias("feature"), scoring.contribution(x, w).alias("contribution")) for d in scoring.DIMENSIONS for x, w in d.weights))
    return rows.select("doc_id", F.inline(every))


@query(f"with {o.analysed(o.TEXTS)} select doc_id, " + ", ".join(f"{o.score(d)} as score_{d.name}, round_even({o.score(d)}, 0)::integer as value_{d.name}" for d in scoring.DIMENSIONS) + " from f")
def dimension_scores(spark, sf_dir):
    rows = scoring.scored(feature_rows(texts(spark, sf_dir), ["doc_id"]))
    from idiolect.functions.numbers import whole

    return rows.select("doc_id", *(c for n in scoring.NAMES for c in (F.col(f"score_{n}"), whole(F.col(f"score_{n}")).alias(f"value_{n}"))))


def renamed(sql: str, suffix: str) -> str:
    """A second set of the CTEs of analysed(), so that samples and corpora fit in one statement."""
    import re

    for name in ("src", "n", "t", "b", "c", "mp", "mt", "f"):
        sql = re.sub(rf"(^|\n|, ?){name} as \((?=select|with)", rf"\g<1>{name}{suffix} as (", sql)
        sql = re.sub(rf"\b(from|join) {name}\b(?! *\()", rf"\g<1> {name}{suffix}", sql)
    return sql.replace("mt.", f"mt{suffix}.").replace("c.", "c.").replace(f"from c{suffix} join", f"from c{suffix} c join")


SCORED = f"with {o.analysed(SAMPLES, 'writer, seq, context')}, {renamed(o.analysed(CORPORA, 'writer'), '_w')}, {o.results('f', 'f_w', 'writer')}"
CONTEXT_SAMPLES = f"select * from ({SAMPLES}) where context is not null"
CONTEXT_CORPORA = f"select writer, context, string_agg(text, chr(10) || chr(10) order by seq) as text from ({CONTEXT_SAMPLES}) group by writer, context"
CONTEXT_SCORED = f"with {o.analysed(CONTEXT_SAMPLES, 'writer, seq, context')}, {renamed(o.analysed(CONTEXT_CORPORA, 'writer, context'), '_w')}, {o.results('f', 'f_w', 'writer, context')}"


def scored_writers(spark, sf_dir):
    return profile.score_groups(profile.usable(samples(spark, sf_dir)), ["writer"])


@query(SCORED + " select writer, dimension, value, confidence, coverage, consistency, array_to_string(sample_values, ' ') as sample_values from r")
def scoring_results(spark, sf_dir):
    rows = scored_writers(spark, sf_dir)[1]
    return rows.select("writer", "dimension", "value", "confidence", "coverage", "consistency", F.array_join(F.col("sample_values").cast("array<string>"), " ").alias("sample_values"))


@query(SCORED + f""", v as (select writer, place, dimension, list_min(sample_values) as low, list_max(sample_values) as high, {o.rounded(o.deviation('sample_values'), 1)} as scatter from r where len(sample_values) >= 2)
select writer, dimension, low, high, scatter, row_number() over (partition by writer order by high - low desc, place)::integer as rank from v where high - low >= 30 and scatter >= 15""")
def contradictions(spark, sf_dir):
    rows = profile.usable(samples(spark, sf_dir)).select("writer", "seq", "text")
    return scoring.contradictions(profile.scored(profile.prepared(rows), ["writer"])[1], ["writer"]).select("writer", "dimension", "low", "high", "scatter", "rank")


@query(CONTEXT_SCORED + " select r.writer, r.context, dimension, value, confidence, f_w.word_count::bigint as word_count from r join f_w on r.writer = f_w.writer and r.context = f_w.context where f_w.word_count >= 200")
def context_profiles(spark, sf_dir):
    rows = profile.context_profiles(samples(spark, sf_dir)).select("writer", "context", "word_count", F.inline("style"))
    return rows.select("writer", "context", "dimension", "value", "confidence", "word_count")


_LABELLED = rf"""select writer, context, text, earlier from (select source as writer, nullif(regexp_replace(regexp_replace(lower(lang), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '') as context, text,
  doc_id in (select doc_id from labels) as earlier from documents) where context is not null and {o.strip("coalesce(text, '')")} <> ''"""


@query(f"""with {o.base(f"select row_number() over () as doc_id, writer, context, earlier, text from ({_LABELLED})", "doc_id, writer, context, earlier")},
k as (select writer, context, coalesce(sum(words) filter (where earlier), 0) as had, sum(words) filter (where not earlier) as asked from b group by writer, context),
l as (select writer, string_agg(context, ', ' order by context) as listed from k where had >= 200 group by writer)
select k.writer, context, coalesce(listed, 'none yet') as listed, (case when had >= 200 then had else had + asked end)::bigint as words,
case when had >= 200 then 'known' when had + asked >= 200 then 'started' else 'too short' end as status from k left join l on k.writer is not distinct from l.writer where asked is not null""")
def started_contexts(spark, sf_dir):
    """Documents with labels are what their sources wrote before; each of the others asks for a context."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("writer"), F.col("doc_id").alias("seq"), F.col("lang").alias("context"), "text")
    docs = spread(docs.where(tx.strip(F.coalesce("text", F.lit(""))) != ""))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    return contexts.outcomes(docs.join(labels, "seq", "left_semi"), docs.join(labels, "seq", "left_anti"))


@query(f"""with c as ({CONTEXT_SCORED} select r.writer, r.context, dimension, value, confidence from r join f_w on r.writer = f_w.writer and r.context = f_w.context where f_w.word_count >= 200),
w as ({SCORED} select writer, dimension, value from r),
d as (select c.writer, context, c.dimension, c.value, c.value - w.value as delta from c join w on c.writer = w.writer and c.dimension = w.dimension where confidence >= 0.45 and abs(c.value - w.value) >= 10)
select * from (select *, row_number() over (partition by writer, context order by abs(delta) desc, dimension)::integer as rank from d) where rank <= 3""")
def context_shift(spark, sf_dir):
    return render.context_shifts(profile.build(samples(spark, sf_dir)))


@query(f"""with {o.analysed(CORPORA, 'writer')} select writer, words::bigint as word_count, sentence_count::bigint as sentence_count, avg_sentence_length, contraction_preference,
{o.rounded('fragment_rate / 100e0', 3)} as fragment_preference, {o.rounded('passive_rate / 100e0', 3)} as passive_preference, vocabulary_diversity,
case when avg_paragraph_length <= 45 then 'short' when avg_paragraph_length <= 90 then 'medium' else 'long' end as paragraph_length,
case when heading_count / greatest(paragraph_count, 1)::double <= 0.08e0 then 'low' when heading_count / greatest(paragraph_count, 1)::double <= 0.30e0 then 'medium' else 'high' end as heading_preference,
case when bullet_count / greatest(paragraph_count, 1)::double <= 0.08e0 then 'low' when bullet_count / greatest(paragraph_count, 1)::double <= 0.30e0 then 'medium' else 'high' end as bullet_preference from f""")
def profile_structure(spark, sf_dir):
    p = profile.build(samples(spark, sf_dir))
    return p.select("writer", "metadata.word_count", "metadata.sentence_count", F.col("syntax.average_sentence_length").alias("avg_sentence_length"), *(F.col(f"syntax.{c}") for c in ("contraction_preference", "fragment_preference", "passive_preference", "vocabulary_diversity")), *(F.col(f"structure.{c}") for c in ("paragraph_length", "heading_preference", "bullet_preference")))


_FACTORS = {d.name: f"(case when words > 0 then least(1e0, words / {float(d.words)!r}::double) else 0e0 end)" for d in scoring.DIMENSIONS}


@query(f"with {o.analysed(o.TEXTS)} " + " union all ".join(f"select doc_id, '{d.name}' as dimension, '{x}' as feature, {o.contribution(x, w)} as contribution, {d.ceiling!r}::double as ceiling, {o.rounded(_FACTORS[d.name], 3)} as coverage, {scoring.SINGLE!r}::double as consistency from f" for d in scoring.DIMENSIONS for x, w in d.weights))
def explained_scores(spark, sf_dir):
    """Each document as the one sample of a writer of its own: what made its scores, and the factors of their confidence."""
    rows = cut(feature_rows(texts(spark, sf_dir), ["doc_id"]).select("doc_id", "word_count", *FEATURES), "features")  # read twice
    told = scoring.explained(scoring.results(rows, scoring.sample_spread(rows, ["doc_id"]), ["doc_id"]))
    return told.select("doc_id", "dimension", F.inline("contributions"), "confidence_factors").select("doc_id", "dimension", "feature", "contribution", "confidence_factors.*")


@query(f"with s as (select * from {_STYLE_ROWS}), d as (select * from {fx.values([(i, d.name) for i, d in enumerate(scoring.DIMENSIONS)], 'place, dimension')}) select writer, coalesce(array_to_string(list(s.dimension order by place) filter (where confidence >= {render.THRESHOLD!r}::double), '|'), '') as confident from s join d on s.dimension = d.dimension group by writer")
def confident_dimensions(spark, sf_dir):
    place = F.create_map(*(F.lit(x) for i, n in enumerate(scoring.NAMES) for x in (n, i)))
    rows = styles(spark, sf_dir).groupBy("writer").agg(F.array_sort(F.collect_list(F.struct(place[F.col("dimension")].alias("place"), "dimension", "value", "confidence"))).alias("style"))
    return rows.select("writer", F.array_join(profile.confident(F.col("style"), render.THRESHOLD), "|").alias("confident"))


@query(f"""with {o.analysed(CORPORA, 'writer')}, k as (select writer, count(*) as sample_count from ({SAMPLES}) group by writer)
select f.writer, sample_count, words::bigint as word_count, sentence_count::bigint as sentence_count, {o.FEATURE_LIST} from f join k on f.writer = k.writer""")
def additive_profiles(spark, sf_dir):
    rows = profile.usable(samples(spark, sf_dir)).select("writer", "seq", "text")
    return profile.corpus_metrics(profile.prepared(rows), ["writer"]).select("writer", "sample_count", "word_count", "sentence_count", *FEATURES)


@query(f"select id, errors from {fx.values(fx.DOCUMENTS_WITH_ERRORS, 'id, errors')} union all select writer, '' from (select distinct writer from ({SAMPLES}))")
def validate_profiles(spark, sf_dir):
    """Broken documents with their faults, and built ones, which have none."""
    p = profile.build(samples(spark, sf_dir), fx.frame(spark, fx.VERDICTS, "writer string, seq long, formal string, plain string, chosen string"))
    built = p.select(F.col("writer").alias("id"), profile.errors(p).alias("errors"))
    broken = fx.frame(spark, fx.DOCUMENTS, "id string, json string").select("id", profile.schema.errors(F.col("json")).alias("errors"))
    return broken.unionByName(built).select("id", F.array_join("errors", "; ").alias("errors"))


_CHOSEN = f"""v as (select *, coalesce(chosen <> formal, true) as avoids from {fx.values(fx.VERDICTS, 'writer, seq, formal, plain, chosen')}), vm as (select *, coalesce(lag(avoids) over (partition by writer, formal order by seq) <> avoids, true) as moved from v),
l as (select writer, formal, arg_max(avoids, seq) as avoids, max(seq) filter (where moved) as since from vm group by 1, 2),
ch as (select writer, coalesce(list(formal order by since) filter (where avoids), []) as against, coalesce(list(formal order by since) filter (where not avoids), []) as pro from l group by 1)"""


def _share(x: str) -> str:
    return o.rounded(f"{x} / 100e0", 3)


def _level(x: str) -> str:
    return f"case when {x} / greatest(paragraph_count, 1)::double <= 0.08e0 then 'low' when {x} / greatest(paragraph_count, 1)::double <= 0.30e0 then 'medium' else 'high' end"


_STYLES = ", ".join(f"max(value) filter (where dimension = '{n}') as value_{n}, max(confidence) filter (where dimension = '{n}') as confidence_{n}" for n in scoring.NAMES)
_SYNTAX = {"average_sentence_length": "avg_sentence_length", "sentence_length_variance": "sentence_length_variance", "average_paragraph_length": "avg_paragraph_length", "contraction_preference": "contraction_preference", "fragment_preference": _share("fragment_rate"), "question_preference": _share("question_rate"), "passive_preference": _share("passive_rate"), "vocabulary_diversity": "vocabulary_diversity"}
_PROFILE_BANDS = ", ".join(f"case when n_{k} = 0 then 'never' when rate_{k} <= {m.BANDS[k][0]} then 'rare' when rate_{k} <= {m.BANDS[k][1]} then 'occasional' else 'frequent' end as band_{k}" for k in profile.PROFILE_MARKS)
PROFILES = f"""with st as ({SCORED} select writer, {_STYLES} from r group by writer),
co as (with {o.analysed(CORPORA, 'writer')}, d as (select *, {o.columns({f'rate_{k}': o.rate(f'n_{k}', 'words', 1000) for k in profile.PROFILE_MARKS})} from f)
  select writer, words::bigint as word_count, sentence_count::bigint as sentence_count, {o.columns(_SYNTAX)}, {_PROFILE_BANDS},
  case when avg_paragraph_length <= 45 then 'short' when avg_paragraph_length <= 90 then 'medium' else 'long' end as paragraph_length, {_level('heading_count')} as heading_preference, {_level('bullet_count')} as bullet_preference from d),
ns as (select writer, count(*) as sample_count from ({SAMPLES}) group by writer),
pr as ({PREFER}), av as ({_avoid()}), tp as (with {TERMS} select * from tops),
rc as (with {o.base(CORPORA, 'writer')}, {recurring_ctes('writer')} select writer, array_to_string(phrases, '|') as phrases from recurring),
cx as ({CONTEXT_SCORED} select writer, string_agg(context, '|' order by context) as contexts from f_w where word_count >= 200 group by writer),
vb as ({SCORED}, v as (select writer, place, dimension, list_min(sample_values) as low, list_max(sample_values) as high, {o.rounded(o.deviation('sample_values'), 1)} as scatter from r where len(sample_values) >= 2)
  select writer, string_agg(dimension, '|' order by high - low desc, place) as varies, string_agg(low || '-' || high, '|' order by high - low desc, place) as ranges from v where high - low >= 30 and scatter >= 15 group by writer),
{_CHOSEN},
wd as (select co.writer, coalesce(against, []) as against, coalesce(pro, []) as pro, string_split(coalesce(nullif(avoid, ''), chr(1)), '|') as guessed, string_split(coalesce(nullif(prefer, ''), chr(1)), '|') as liked
  from co left join av on co.writer = av.writer left join pr on co.writer = pr.writer left join ch on co.writer = ch.writer),
wl as (select writer, against, list_concat(against, list_filter(guessed, lambda a: a <> chr(1) and not list_contains(against, a) and not list_contains(pro, a))[1:greatest(0, 12 - len(against))]) as avoid,
  list_concat(list_filter(liked, lambda a: a <> chr(1)), list_filter(pro, lambda a: not list_contains(liked, a))) as prefer from wd)
select co.*, st.* exclude (writer), sample_count, 'voice_' || substr(sha256(co.writer), 1, 12) as profile_id, array_to_string(wl.prefer, '|') as prefer, array_to_string(wl.avoid, '|') as avoid,
  array_to_string(list_filter(wl.avoid, lambda a: list_contains(against, a)), '|') as confirmed, len(list_filter(wl.avoid, lambda a: not list_contains(against, a))) > 0 as guessed,
  coalesce(technical_terms, '') as technical_terms, coalesce(colloquialisms, '') as colloquialisms, coalesce(phrases, '') as phrases, coalesce(contexts, '') as contexts, coalesce(varies, '') as varies, coalesce(ranges, '') as ranges
from co join st on co.writer = st.writer join ns on co.writer = ns.writer join wl on co.writer = wl.writer left join tp on co.writer = tp.writer left join rc on co.writer = rc.writer left join cx on co.writer = cx.writer left join vb on co.writer = vb.writer"""


@query(PROFILES)
def profile_documents(spark, sf_dir):
    """The documents, read again from their JSON."""
    p = profile.build(samples(spark, sf_dir), fx.frame(spark, fx.VERDICTS, "writer string, seq long, formal string, plain string, chosen string"))
    d = profile.parsed(p.select("writer", profile.to_json(p).alias("json")))
    style = F.map_from_entries(F.transform("style", lambda x: F.struct(x["dimension"], x)))
    joined = lambda c: F.array_join(c, "|")
    return d.withColumn("by", style).select(
        "writer", "profile_id", "metadata.sample_count", "metadata.word_count", "metadata.sentence_count", "syntax.*", "structure.*",
        *(F.col("by")[n][c].alias(f"{c}_{n}") for n in scoring.NAMES for c in ("value", "confidence")), *(F.col("punctuation")[k].alias(f"band_{k}") for k in profile.PROFILE_MARKS),
        *(joined(f"vocabulary.{c}").alias(c) for c in ("prefer", "avoid", "technical_terms", "colloquialisms")), joined("phrasing.preferred").alias("phrases"),
        joined("notes.avoid_confirmed_by_choice").alias("confirmed"), F.col("notes.avoid_inferred_from_absence").alias("guessed"),
        joined(F.transform("contexts", lambda c: c["context"])).alias("contexts"), joined(F.transform("notes.varies_by_context", lambda v: v["dimension"])).alias("varies"),
        joined(F.transform("notes.varies_by_context", lambda v: F.concat_ws("-", v["low"].cast("string"), v["high"].cast("string")))).alias("ranges"),
    )


def _list(items: Iterable[str]) -> str:
    """SQL list of the items that are not null."""
    return f"list_filter([{', '.join(items)}]::varchar[], lambda x: x is not null)"


def _joined(*items: str) -> str:
    return f"array_to_string({_list(items)}, chr(10))"


def _english(x: str) -> str:
    return f"case len({x}) when 0 then '' when 1 then {x}[1] else array_to_string({x}[:-2], ', ') || ' and ' || {x}[-1] end"


def _capital(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _when(*cases: tuple[str, str], other: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {x}" for c, x in cases) + f" else {other} end"


def _marked(band: str) -> str:
    return _list(_when((f"band_{k} = '{band}'", fx.quoted(render.MARK_NAMES[k]))) for k in sorted(profile.PROFILE_MARKS))


def _phrase(d: str) -> str:
    return _when(*((f"value_{d} <= {high}", fx.quoted(x)) for high, x in zip((20, 40, 60, 80, 100), render.PHRASES[d])))


def _some(x: str, text: str) -> str:
    return _when((f"len({x}) > 0", text))


def _rendered() -> str:
    """Every profile's texts, from the columns of PROFILES."""
    q, say, split = fx.quoted, render.SAY, lambda c: f"case when {c} = '' then []::varchar[] else string_split({c}, '|') end"
    words = "round_even(average_sentence_length, 0)::integer"
    style = _list(_when((f"confidence_{n} >= 0.45", _phrase(n))) for n in scoring.NAMES)
    unsure = _list(_when((f"confidence_{n} < 0.45", q(n))) for n in sorted(scoring.NAMES))
    lists = f"""select writer, {style} as sure, {unsure} as unsure, {_marked('never')} as never, {_marked('frequent')} as often,
{', '.join(f"{split(c)} as {c}" for c in ('prefer', 'avoid', 'confirmed', 'technical_terms', 'phrases', 'varies', 'ranges'))},
{_list([
    _when(("contraction_preference >= 0.5", q(say["contracts"])), ("contraction_preference <= 0.15", q(say["rarely"]))),
    _when(("average_sentence_length <> 0", f"'your sentences average about ' || {words} || ' words ' || " + _when(("sentence_length_variance >= 60", "'and vary their length a lot'"), ("sentence_length_variance <= 20", "'and keep them fairly even in length'"), other="'with some variation in length'"))),
    "'your paragraphs are ' || paragraph_length", _when(("bullet_preference = 'high'", q(say["bullets"]))),
])} as detail, p.* exclude (writer, prefer, avoid, confirmed, technical_terms, phrases, varies, ranges) from p"""
    hint = "'  - ' || w || case when list_contains(confirmed, w) then '' else '  ?' end"
    summary = _joined(
        _when(("len(sure) > 0", f"'You''re ' || {_english('sure[:3]')} || '.'"), other=q(say["nothing"].format(tool=render.TOOL))),
        _when(("len(sure) > 0 and len(detail) > 0", f"rtrim({_capital(f'({_english("detail")})')}, '.') || '.'")),
        _when(("len(sure) > 0 and len(never) > 0", f"'You never use: ' || {_english('never')} || '.'")),
        _some("unsure", f"'Not yet confident about: ' || {_english('unsure')} || {q(say['unsure'])}"),
        _some("prefer", f"{q(chr(10) + 'Prefer' + chr(10))} || array_to_string(list_transform(prefer, lambda w: '  - ' || w), chr(10))"),
        _some("avoid", f"{q(chr(10) + 'Avoid' + chr(10))} || array_to_string(list_transform(avoid, lambda w: {hint}), chr(10)) || " + _when(("guessed", q(chr(10) + say["guess"])), other="''")),
    )
    listed = lambda before, x, items: _some(x, f"{q(before)} || array_to_string({items}, ', ') || '.'")
    chosen, hinted = "list_filter(avoid, lambda w: list_contains(confirmed, w))", "list_filter(avoid, lambda w: not list_contains(confirmed, w))"
    instructions = _joined(
        q(say["voice"]), "''",
        _when(("len(sure) = 0", q(say["unknown"])), other=f"array_to_string(list_transform(sure, lambda x: '- ' || {_capital('x')} || '.'), chr(10))"),
        _when(("average_sentence_length <> 0", f"'- Sentences average around ' || {words} || ' words. ' || " + _when(("sentence_length_variance >= 60", "'Vary their length noticeably.'"), other="'Keep their length fairly even.'"))),
        _when(("contraction_preference >= 0.5", "'- Use contractions naturally.'"), ("contraction_preference <= 0.15", "'- Avoid contractions.'")),
        _when(("fragment_preference >= 0.1", "'- Occasional sentence fragments are in character.'")),
        _when(("passive_preference <= 0.1", "'- Prefer active voice.'")),
        "'- Keep paragraphs ' || paragraph_length || '.'",
        _when(("bullet_preference = 'high'", "'- Bullet points are welcome.'"), ("bullet_preference = 'low'", "'- Prefer prose over bullet points.'")),
        _when(("heading_preference = 'low'", "'- Use few or no headings.'")),
        _some("never", f"'- Do not use: ' || {_english('never')} || '.'"),
        _some("often", f"'- They use ' || {_english('often')} || ' freely.'"),
        listed("- Vocabulary they reach for: ", "prefer", "prefer"),
        listed("- Turns of phrase they use: ", "phrases", "phrases"),
        listed("- They chose against these words when asked directly, so never use them: ", chosen, chosen),
        listed("- Words absent from their writing, so probably avoid: ", hinted, hinted),
        listed("- Domain vocabulary they use without explaining: ", "technical_terms", "technical_terms[:8]"),
        *map(q, render.CONSTRAINTS),
    )
    bars = [f"'  ' || rpad({q(n.capitalize())}, 18, ' ') || ' ' || lpad(value_{n}::varchar, 3, ' ') || '  ' || repeat('█', round_even(value_{n} / 100e0 * 10, 0)::integer) || repeat('░', 10 - round_even(value_{n} / 100e0 * 10, 0)::integer) || '  conf ' || printf('%.2f', confidence_{n}::double) || case when confidence_{n} >= 0.7 then '  ' when confidence_{n} >= 0.45 then ' ?' else ' ??' end" for n in scoring.NAMES]
    variation = _some("varies", "chr(10) || " + _joined(
        "'  You write very differently in different places'",
        f"array_to_string(list_transform(varies[:3], lambda x, i: '    ' || rpad({_capital('x')}, 18, ' ') || ' ' || ranges[i] || ' across samples'), chr(10))",
        _some("varies[4:]", "'    and ' || len(varies[4:]) || ' more: ' || array_to_string(varies[4:], ', ')"),
        "'  That is context, not error -- but the single value above is an average of both.'",
        _when(("contexts = ''", f"'  Split them with: {render.TOOL} analyse FILE --save --context work'")),
    ))
    report = _joined(
        q("Your Voice Profile\n"), *bars, "chr(10) || '  Samples analysed: ' || sample_count", "'  Words analysed:   ' || format('{:,}', word_count)",
        _when((" or ".join(f"confidence_{n} < 0.7" for n in scoring.NAMES), q("\n  ? low confidence   ?? not yet established"))), variation, "chr(10) || summary",
    )
    start, end = render.markers()
    head = f"{start}\n<!-- Generated by {render.TOOL}. Anything between these markers is\n     replaced on the next run. Refresh: {render.refresh_command('AGENTS.md')} -->\n\n## Writing voice\n\n{render.SCOPE}\n\n"
    return f"""with p as ({PROFILES}), l as ({lists}), t as (select *, {summary} as summary, {instructions} as instructions from l)
select writer, summary, instructions, {report} as report, {q(head)} || instructions || {q(chr(10) + end)} as block from t"""


@query(_rendered())
def rendered_profiles(spark, sf_dir):
    p = profile.build(samples(spark, sf_dir), fx.frame(spark, fx.VERDICTS, "writer string, seq long, formal string, plain string, chosen string"))
    return p.select("writer", render.summary().alias("summary"), render.instructions().alias("instructions"), render.report().alias("report"), render.block(render.instructions()).alias("block"))


@query(f"""with v as (select *, coalesce(chosen <> formal, true) as avoids from {_VERDICTS}), w as (select *, coalesce(lag(avoids) over (partition by writer, formal order by seq) <> avoids, true) as moved from v)
select writer, formal, arg_max(avoids, seq) as avoids, max(seq) filter (where moved)::bigint as since from w group by 1, 2""")
def verdict_latest_wins(spark, sf_dir):
    return profile.latest_verdicts(verdicts(spark, sf_dir))


@query(f"""with v as (select *, coalesce(chosen <> formal, true) as avoids from {_VERDICTS}), w as (select *, coalesce(lag(avoids) over (partition by writer, formal order by seq) <> avoids, true) as moved from v),
l as (select writer, formal, arg_max(avoids, seq) as avoids, max(seq) filter (where moved) as since from w group by 1, 2),
c as (select writer, coalesce(list(formal order by since) filter (where avoids), []) as against, coalesce(list(formal order by since) filter (where not avoids), []) as pro from l group by 1),
g as (select x.writer, x.avoid, coalesce(against, []) as against, coalesce(pro, []) as pro from {_VOCABULARIES} x left join c on x.writer = c.writer)
select writer, array_to_string(list_concat(against, list_filter(avoid, lambda a: not list_contains(against, a) and not list_contains(pro, a))[1:greatest(0, 12 - len(against))]), '|') as avoid, array_to_string(list_concat(['so'], list_filter(pro, lambda a: a <> 'so')), '|') as prefer from g""")
def avoid_merge(spark, sf_dir):
    rows = vocabularies(spark, sf_dir).join(profile.chosen_words(verdicts(spark, sf_dir)), "writer", "left")
    none = F.array().cast("array<string>")
    against, pro = F.coalesce("against", none), F.coalesce("chosen_for", none)
    return rows.select("writer", F.array_join(profile.merged_avoid(F.col("avoid"), against, pro), "|").alias("avoid"), F.array_join(profile.merged_prefer(F.array(F.lit("so")), pro), "|").alias("prefer"))


# --- calibration -------------------------------------------------------------------------------------------------

_DIMS = fx.values([(i, d.name, d.ceiling, d.importance) for i, d in enumerate(scoring.DIMENSIONS)], "place, dimension, ceiling, importance")
_BANK = fx.values([(q.id, i, t, q in cal.CALIBRATION) for q in cal.ONBOARDING + cal.CALIBRATION for i, t in enumerate(q.targets)], "question_id, position, target, calibrates")
_CALIBRATION = f"""with s as materialized (select * from {_STYLE_ROWS}), w as (select distinct writer from s union select * from {fx.values(fx.WRITERS, 'writer')}), d as (select * from {_DIMS}), k as (select * from {_BANK}),
a as ({_ASKED}), dk as (select * from (values (0, 1e0), (1, 0.6e0), (2, 0.36e0)) as v(position, decay)),
u as (select w.writer, d.place, d.dimension, d.importance::double as importance, {o.rounded('greatest(0e0, least(1e0, (ceiling::double - coalesce(confidence::double, 0e0)) / ceiling::double))', 4)} as uncertainty from w cross join d left join s on s.writer = w.writer and s.dimension = d.dimension),
sat as (select writer, target, sum(decay) as saturation from a join k on a.question_id = k.question_id join dk on dk.position = k.position group by 1, 2),
p as (select u.*, coalesce(saturation, 0e0) as saturation, {o.rounded('uncertainty * importance / (1e0 + coalesce(saturation, 0e0))', 6)} as priority from u left join sat on sat.writer = u.writer and sat.target = u.dimension),
q as (select p.writer, k.question_id, k.position, k.target, {o.rounded('uncertainty * importance * decay / (1e0 + saturation)', 6)} as v from p join k on k.target = p.dimension and k.calibrates join dk on dk.position = k.position),
qs as (select writer, question_id, {o.rounded('sum(v)', 6)} as priority, string_agg(target, ', ' order by v desc, target) filter (where v > 0) as reason from q group by 1, 2)"""


@query(_CALIBRATION + " select writer, dimension, uncertainty, round(saturation, 6) as saturation, priority from p")
def dimension_priority(spark, sf_dir):
    return cal.worth(styles(spark, sf_dir), asked(spark, sf_dir), writers(spark, sf_dir)).select("writer", "dimension", "uncertainty", F.round("saturation", 6).alias("saturation"), "priority")


@query(_CALIBRATION + " select writer, dimension, priority, rank from (select *, row_number() over (partition by writer order by priority desc, dimension)::integer as rank from p) where rank <= 3")
def weakest_dimensions(spark, sf_dir):
    return cal.weakest(styles(spark, sf_dir), asked(spark, sf_dir), writers(spark, sf_dir)).select("writer", "dimension", "priority", "rank")


@query(_CALIBRATION + " select writer, question_id, priority, reason, row_number() over (partition by writer order by priority desc, question_id)::integer as rank from qs where not exists (select 1 from a where a.writer = qs.writer and a.question_id = qs.question_id)")
def question_rank(spark, sf_dir):
    return cal.rank_questions(styles(spark, sf_dir), asked(spark, sf_dir), writers(spark, sf_dir))


def _rounds() -> str:
    """The ranking of questions, three times, each with the ones before counted as asked."""
    head = _CALIBRATION[: _CALIBRATION.index("sat as (")]
    ctes, asked_before = [], "select writer, question_id from a"
    for i in (1, 2, 3):
        ctes.append(f"""a{i} as ({asked_before}),
sat{i} as (select writer, target, sum(decay) as saturation from a{i} join k on a{i}.question_id = k.question_id join dk on dk.position = k.position group by 1, 2),
p{i} as (select u.*, coalesce(saturation, 0e0) as saturation from u left join sat{i} on sat{i}.writer = u.writer and sat{i}.target = u.dimension),
q{i} as (select p{i}.writer, k.question_id, {o.rounded('uncertainty * importance * decay / (1e0 + saturation)', 6)} as v from p{i} join k on k.target = p{i}.dimension and k.calibrates join dk on dk.position = k.position),
best{i} as (select writer, question_id, {o.rounded('sum(v)', 6)} as priority from q{i} where not exists (select 1 from a{i} where a{i}.writer = q{i}.writer and a{i}.question_id = q{i}.question_id) group by 1, 2 qualify row_number() over (partition by writer order by priority desc, question_id) = 1)""")
        asked_before = f"select * from a{i} union all select writer, question_id from best{i}"
    return head + ", ".join(ctes) + " " + " union all ".join(f"select writer, {i} as round, question_id, priority from best{i}" for i in (1, 2, 3))


@query(_rounds())
def question_selection(spark, sf_dir):
    return cal.select_questions(styles(spark, sf_dir), asked(spark, sf_dir), writers(spark, sf_dir))


@query(f"""with v as (select * from {_VOCABULARIES}), p as (select * from {fx.values([(i, k, f, q) for k, (i, f, q) in enumerate(cal.PAIRS)], 'pair_id, place, formal, plain')}), a as (select * from {_ASKED_PAIRS}),
r as (select writer, pair_id, formal, plain, list_contains(avoid, formal) and not list_contains(confirmed, formal) as pending, place from v cross join p where not exists (select 1 from a where a.writer = v.writer and a.pair_id = p.pair_id))
select writer, pair_id, formal, plain, pending, rank from (select *, row_number() over (partition by writer order by pending desc, place)::integer as rank from r) where rank <= 3""")
def pair_rank(spark, sf_dir):
    return cal.select_pairs(vocabularies(spark, sf_dir), asked_pairs(spark, sf_dir))


@query(f"select writer, question_id as source, min(seq)::bigint as since from ({_ASKED}) where question_id in {o.lit(q.id for q in cal.ONBOARDING + cal.CALIBRATION)} group by 1, 2")
def answered_questions(spark, sf_dir):
    log = asked(spark, sf_dir).withColumnRenamed("question_id", "source")
    return evidence.answered(log, cal.question_bank(spark, cal.ONBOARDING + cal.CALIBRATION), ["writer"])


@query(f"""with st as materialized (select * from {_STYLE_ROWS}), k as (select case writer when 'ada' then 'x' when 'ben' then 'x' else (writer::bigint // 2)::varchar end as writer, case writer when 'ada' then 0 when 'ben' then 1 else writer::bigint % 2 end as side, dimension, confidence from st),
a as (select * from k where side = 0), b as (select * from k where side = 1),
m as (select coalesce(a.writer, b.writer) as writer, coalesce(a.dimension, b.dimension) as dimension, a.confidence::double as before, b.confidence::double as after, coalesce(a.confidence, 0)::double as x, coalesce(b.confidence, 0)::double as y from a full join b on a.writer = b.writer and a.dimension = b.dimension)
select writer, dimension, before, after, {o.rounded('abs(y - x)', 4)} as delta, case when y > x then 'up' else 'down' end as direction from m where {o.rounded('abs(y - x)', 4)} >= 0.01""")
def confidence_movement(spark, sf_dir):
    """From the style of each document with an even id to that of the one after it."""
    named = {"ada": ("x", 0), "ben": ("x", 1)}
    number = F.col("writer").try_cast("long")
    key = F.when(F.col("writer").isin(*named), "x").otherwise(F.floor(number / 2).cast("string"))
    side = F.when(F.col("writer") == "ada", 0).when(F.col("writer") == "ben", 1).otherwise(number % 2)
    rows = styles(spark, sf_dir).select(key.alias("writer"), side.alias("side"), "dimension", "value", "confidence")
    flat = lambda k: rows.where(F.col("side") == k).groupBy("writer").agg(F.collect_list(F.struct("dimension", "value", "confidence")).alias("style"))
    return profile.movement(flat(0), flat(1), ["writer"])


# --- rendering ---------------------------------------------------------------------------------------------------

_PHRASES = fx.values([(d, high, p) for d, phrases in render.PHRASES.items() for high, p in zip((20, 40, 60, 80, 100), phrases)], "dimension, high, phrase")


@query(f"""with s as (select * from {_STYLE_ROWS}), p as (select * from {_PHRASES})
select writer, s.dimension, (select arg_min(phrase, high) from p where p.dimension = s.dimension and s.value <= high) as phrase, confidence >= 0.45 as established,
repeat('█', round_even(value / 100e0 * 10, 0)::integer) || repeat('░', 10 - round_even(value / 100e0 * 10, 0)::integer) as bar, case when confidence >= 0.7 then '  ' when confidence >= 0.45 then ' ?' else ' ??' end as doubt from s""")
def describe_bands(spark, sf_dir):
    s = styles(spark, sf_dir)
    return s.select("writer", "dimension", render.describe(F.col("dimension"), F.col("value")).alias("phrase"), (F.col("confidence") >= render.THRESHOLD).alias("established"), render.bar(F.col("value")).alias("bar"), render.doubt(F.col("confidence")).alias("doubt"))


@query(f"with l as (select page_id as id, list_filter(string_split(url, '/'), lambda p: p <> '') as x from pages union all select -id, x from {fx.values(fx.LISTS, 'id, x')}) select id, case len(x) when 0 then '' when 1 then x[1] else array_to_string(x[:-2], ', ') || ' and ' || x[-1] end as joined from l")
def english_lists(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.filter(F.split("url", "/"), lambda p: p != "").alias("x"))
    rows = own.unionByName(fx.frame(spark, [(-i, x) for i, x in fx.LISTS], "id long, x array<string>"))
    return rows.select("id", tx.english_list(F.col("x")).alias("joined"))


_START, _END = render.markers()
_FILES = [(i, None if t is None else t.format(start=_START, end=_END)) for i, t in fx.FILES]
_NEW = f"{_START}\nnew\n{_END}"
_SPLICED = [
    (1, _NEW + "\n", "created", None), (2, _NEW + "\n", "created", None), (3, f"# Notes\n\nkeep\n\n{_NEW}\n", "appended", None), (4, f"a\n{_NEW}\nz\n", "replaced", None),
    (5, f"a\n{_NEW}\nz\n".replace("\n", "\r\n"), "replaced", None), (6, f"  {_START}\nindented\n\n{_NEW}\n", "appended", None), (7, None, None, "a start without an end"),
    (8, None, None, "the end comes before the start"), (9, None, None, "more than one block"), (10, f"no newline at end\n\n{_NEW}\n", "appended", None), (11, None, None, "an end without a start"),
]


_MARKED = {1: ("", f"{_START}\nold\n{_END}\n"), 2: ("", ""), 3: (f"\n{_START}\nno end", ""), 4: (f"\n{_END}", "")}
_FAULTS = {3: "a start without an end", 4: "an end without a start"}


def _spliced() -> str:
    """Documents as files: as they are, after a block, before a start or an end alone."""
    nl, new = "chr(10)", fx.quoted(_NEW)
    ended = lambda x: f"case when right({x}, 1) = {nl} then {x} else {x} || {nl} end"
    body = f"case k when 1 then {ended(f'({new} || {nl} || unix)')} else regexp_replace(unix, '\n+$', '') || {nl} || {nl} || {new} || {nl} end"
    good = f"case when blank and k <> 1 then {new} || {nl} when contains(t, chr(13) || chr(10)) then replace({body}, {nl}, chr(13) || chr(10)) else {body} end"
    fault = f"case k when 3 then {fx.quoted(_FAULTS[3])} when 4 then {fx.quoted(_FAULTS[4])} end"
    return f"""with d as (select doc_id + 100 as id, coalesce(text, '') as t, doc_id % 5 as k from documents), u as (select *, replace(t, chr(13) || chr(10), {nl}) as unix, {o.strip('t')} = '' as blank from d)
select id, case when {fault} is null then {good} end as text, case when {fault} is null then case when k = 1 then 'replaced' when blank then 'created' else 'appended' end end as action, {fault} as error from u
union all select id, text, action, error from {fx.values(_SPLICED, 'id, text, action, error')}"""


@query(_spliced())
def splice_block(spark, sf_dir):
    kind, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    before = F.when(kind == 1, _MARKED[1][1]).otherwise("")
    after = F.when(kind == 3, _MARKED[3][0]).when(kind == 4, _MARKED[4][0]).otherwise("")
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.concat(before, text, after).alias("existing"))
    rows = own.unionByName(fx.frame(spark, _FILES, "id long, existing string"))
    return rows.select("id", F.inline(F.array(render.splice(F.col("existing"), F.lit(_NEW)))))


# --- streaming ---------------------------------------------------------------------------------------------------


@query("select event_type as kind, count(*) as n, sum(user_id)::bigint as words from events group by 1")
def stream_counts(spark, sf_dir):
    """The log's running counts, over the events table read as a stream to its end."""
    import uuid

    from idiolect.streaming import evidence as stream

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    log = spark.readStream.schema(schema).parquet(path + "*").select(F.col("event_type").alias("kind"), F.col("user_id").alias("word_count"))
    name = f"counts_{uuid.uuid4().hex}"
    run = stream.counts_by_kind(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/idiolect-{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's eight dimensions with value and confidence."""
    return scored_writers(spark, sf_dir)[1].select("writer", "dimension", "value", "confidence", "coverage", "consistency")
