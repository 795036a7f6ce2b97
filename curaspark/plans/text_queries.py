"""Queries of text functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.functions import answers as A
from curaspark.functions import text as T
from curaspark.operators import metrics, votes
from curaspark.plans.common import deliveries, register, speech, sql_list, table
from curaspark.sources import readers

STRIP = r"[\x09-\x0d\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{STRIP}+|{STRIP}+$', '', 'g')"


def sql_straight(x: str) -> str:
    return f"replace(replace({x}, chr(8217), ''''), chr(8216), '''')"


SPEECH_SQL = "(SELECT DISTINCT task_id, model, persona_id, \"group\", sentiment, text, is_refused, refusal_reason, finish_reason, input_tokens, output_tokens, toxicity FROM personas_merged_speech)"


# Posts: marks that the cleaning handles are put into a part of the texts, by a digit of a digest.
def _posts(spark, folder):
    digit = F.substring(F.md5(F.concat(F.lit("inj|"), F.col("task_id").cast("string"))), 1, 1)
    link = F.concat(F.lit('<a href="#p" class="quotelink">&gt;&gt;'), F.col("task_id").cast("string"), F.lit("</a>"), F.col("text"))
    quote = F.concat(F.lit('<span class="quote">&gt;so\nthey say</span>'), F.col("text"), F.lit("<BR />"))
    entity = F.concat(F.col("text"), F.lit(" &amp;lt;b&gt; &quot;x&quot; &#039;y&#039;<br>z&nbsp;"))
    marked = F.when(digit.isin("0", "1"), link).when(digit.isin("2", "3"), quote).when(digit.isin("4", "5"), entity).otherwise(F.col("text"))
    return deliveries(spark, folder).select("task_id", marked.alias("html"), "toxicity")


POSTS_SQL = f"""(SELECT task_id, toxicity, CASE
 WHEN d IN ('0', '1') THEN '<a href="#p" class="quotelink">&gt;&gt;' || task_id || '</a>' || text
 WHEN d IN ('2', '3') THEN '<span class="quote">&gt;so' || chr(10) || 'they say</span>' || text || '<BR />'
 WHEN d IN ('4', '5') THEN text || ' &amp;lt;b&gt; &quot;x&quot; &#039;y&#039;<br>z&nbsp;' ELSE text END AS html
 FROM (SELECT *, substring(md5('inj|' || task_id), 1, 1) AS d FROM {SPEECH_SQL}))"""


def sql_clean(x: str) -> str:
    out = rf"""regexp_replace({x}, '<span\s+class="quote">(?s:.*?)</span>', '', 'g')"""
    out = rf"""regexp_replace({out}, '<a[^>]*class="quotelink"[^>]*>.*?</a>', '', 'g')"""
    for entity, char in (("&#039;", "''"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<")):
        out = f"replace({out}, '{entity}', '{char}')"
    return sql_strip(rf"regexp_replace({out}, '(?i)<br\s*/?>', ' ', 'g')")


@register(f"SELECT task_id, {sql_clean('html')} AS cleaned FROM {POSTS_SQL}")
def html_clean(spark, folder):
    return _posts(spark, folder).select("task_id", T.clean_post(F.col("html")).alias("cleaned")).distinct()


_ID_SQL = r"""CASE WHEN html IS NULL THEN NULL WHEN regexp_extract(html, 'class="quotelink"[^>]*>.*?&gt;&gt;(\d+)<', 1) <> ''
 THEN regexp_extract(html, 'class="quotelink"[^>]*>.*?&gt;&gt;(\d+)<', 1) ELSE substring(md5(html), 1, 10) END"""


@register(f"SELECT task_id, {_ID_SQL} AS post_id FROM {POSTS_SQL}")
def ref_id_extract(spark, folder):
    return _posts(spark, folder).select("task_id", T.post_id(F.col("html")).alias("post_id")).distinct()


@register(
    f"SELECT {_ID_SQL} AS post_id, {sql_clean('html')} AS cleaned_post FROM {POSTS_SQL} WHERE html IS NOT NULL AND coalesce(toxicity, 0) > 0.7 AND length({sql_clean('html')}) > 500"
)
def explode_filter_clean(spark, folder):
    post = F.struct(F.col("html").alias("com"), F.when(F.col("toxicity").isNotNull(), F.create_map(F.lit("TOXICITY"), "toxicity")).otherwise(F.create_map(F.lit("OTHER"), F.lit(1.0))).alias("perspectives"))
    threads = _posts(spark, folder).distinct().select(F.array(post, F.struct(F.lit(None).cast("string").alias("com"), F.lit(None).cast("map<string,double>").alias("perspectives"))).alias("posts"))
    return readers.posts_of(threads).select("post_id", "cleaned_post")


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS score FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 > 0.7")
def json_prop_filter(spark, folder):
    score = F.from_json("props", "map<string,double>")
    events = table(spark, folder, "events").select("event_id", F.try_element_at(score, F.lit("k")).alias("k"))
    return events.select("event_id", (F.col("k") / 100).alias("score")).where("score > 0.7")


@register(f"SELECT task_id, {sql_straight('text')} AS plain FROM {SPEECH_SQL}")
def quote_normalize(spark, folder):
    return speech(spark, folder).select("task_id", T.straight_quotes(F.col("text")).alias("plain"))


_WINDOW_SQL = sql_strip(f"substring({sql_straight('text')}, 1, 150)")


@register(
    f"""SELECT task_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty_response'
 ELSE array_to_string(list_filter({sql_list(T.KEYWORDS)}, lambda p: contains(lower({_WINDOW_SQL}), lower(p))), '|') END AS found,
 CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty_response'
 ELSE nullif(array_to_string(list_filter({sql_list(T.KEYWORDS)}, lambda p: contains(lower({_WINDOW_SQL}), lower(p)))[1:3], ', '), '') END AS reason FROM {SPEECH_SQL}"""
)
def refusal_keywords(spark, folder):
    text = F.col("text")
    return deliveries(spark, folder).select("task_id", F.array_join(T.refusal_keywords(text), "|").alias("found"), T.keyword_reason(text).alias("reason")).distinct()


def sql_soft(x: str) -> str:
    phrase = f"list_filter({sql_list(T.SOFT_PHRASES)}, lambda p: contains(lower({sql_straight(f'substring({x}, 1, 400)')}), lower(p)))[1]"
    return f"CASE WHEN coalesce(length({sql_strip(x)}), 0) < 20 THEN 'too_short' ELSE 'soft_refusal: ' || {phrase} END"


@register(f"SELECT task_id, {sql_soft('text')} AS reason FROM {SPEECH_SQL}")
def soft_refusal(spark, folder):
    return deliveries(spark, folder).select("task_id", T.soft_refusal(F.col("text")).alias("reason")).distinct()


def _with_commentary(spark, folder):
    digit = F.substring(F.md5(F.concat(F.lit("note|"), F.col("task_id").cast("string"))), 1, 1)
    text = F.col("text")
    marked = (
        F.when(digit == "0", F.concat(text, F.lit("\nNote: made up\nKey points of it")))
        .when(digit == "1", F.concat(text, F.lit(" Wait, that is odd. Let me see.")))
        .when(digit == "2", F.concat(text, F.lit("\n\nThis is how the character talks.\n\nMore.")))
        .when(digit == "3", F.concat(text, F.lit("\n---\nHmm, no.")))
        .otherwise(text)
    )
    return speech(spark, folder).select("task_id", marked.alias("text"))


@register(None)
def reasoning_trim(spark, folder):
    return _with_commentary(spark, folder).select("task_id", T.trim_reasoning(F.col("text")).alias("trimmed"))


def _sql_starter() -> str:
    heads = f"list_filter(list_transform({sql_list(T.STARTERS)}, lambda s: CASE WHEN instr(text, s) - 1 > 50 THEN regexp_replace(substring(text, 1, instr(text, s) - 1), '{STRIP}+$', '') END), lambda h: length(h) > 50)"
    return f"coalesce({heads}[1], text)"


@register(
    f"""SELECT task_id, {_sql_starter()} AS trimmed FROM (SELECT task_id, CASE substring(md5('note|' || task_id), 1, 1)
 WHEN '0' THEN text || chr(10) || 'Note: made up' || chr(10) || 'Key points of it' WHEN '1' THEN text || ' Wait, that is odd. Let me see.'
 WHEN '2' THEN text || chr(10) || chr(10) || 'This is how the character talks.' || chr(10) || chr(10) || 'More.'
 WHEN '3' THEN text || chr(10) || '---' || chr(10) || 'Hmm, no.' ELSE text END AS text FROM {SPEECH_SQL})"""
)
def reasoning_starters(spark, folder):
    return _with_commentary(spark, folder).select("task_id", T.cut_at_starter(F.col("text")).alias("trimmed"))


JUDGES = ["alder", "birch", "cedar", "dogwood", "elm", "fir"]
LABELED = "personas_merged_speech_labeled_6judge"
_VERDICTS_SQL = "(" + " UNION ALL ".join(f"SELECT DISTINCT original_idx, labeled_at, '{j}' AS judge, judge_{j} AS is_hate, judge_{j}_raw AS raw FROM {LABELED}" for j in JUDGES) + ")"


def verdicts(spark, folder):
    wide = table(spark, folder, LABELED)
    keyed = wide.withColumn("key", F.struct("original_idx", "labeled_at"))
    return votes.to_long(keyed, JUDGES, "key").select("key.*", "judge", "is_hate", "raw").distinct()


_WORD_SQL = f"""regexp_replace(regexp_extract(p, '^([^\\x09-\\x0d\\x1c-\\x20\\x{{A0}}]+)', 1), '^[.,!?:;"'']+|[.,!?:;"'']+$', '', 'g')"""


@register(
    f"""SELECT raw, n, CASE WHEN coalesce(p, '') = '' THEN NULL WHEN {_WORD_SQL} IN ('yes', 'true', '1') THEN true WHEN {_WORD_SQL} IN ('no', 'false', '0') THEN false
 WHEN contains(substring(p, 1, 20), 'yes') THEN true WHEN contains(substring(p, 1, 20), 'no') THEN false END AS verdict
 FROM (SELECT raw, lower({sql_strip('raw')}) AS p, count(*) AS n FROM {_VERDICTS_SQL} GROUP BY raw)"""
)
def yes_no_parse(spark, folder):
    counted = verdicts(spark, folder).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("raw", "n", T.yes_no(F.col("raw")).alias("verdict"))


@register(
    f"""SELECT raw, n, CASE WHEN raw IS NULL THEN NULL ELSE starts_with(lower(p), 'unsafe') AND contains(coalesce(string_split(p, chr(10))[2], ''), 'S10') END AS verdict
 FROM (SELECT raw, {sql_strip('raw')} AS p, count(*) AS n FROM {_VERDICTS_SQL} WHERE judge = 'fir' GROUP BY raw)"""
)
def guard_parse(spark, folder):
    counted = verdicts(spark, folder).where("judge = 'fir'").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("raw", "n", T.guard_verdict(F.col("raw")).alias("verdict"))


@register(f"SELECT original_idx, labeled_at, bool_or(judge_alder) OR bool_or(judge_birch) AS flagged FROM {LABELED} GROUP BY original_idx, labeled_at")
def moderation_parse(spark, folder):
    flags = table(spark, folder, LABELED).groupBy("original_idx", "labeled_at").agg(F.bool_or("judge_alder").alias("a"), F.bool_or("judge_birch").alias("b"))
    return flags.select("original_idx", "labeled_at", T.moderation_verdict(F.col("a"), F.col("b")).alias("flagged"))


_FAMILY = {"argon-8b": "meta-llama/Argon", "basalt-mini": "openai/gpt-oss-20b", "cobalt-chat": "Qwen/Cobalt", "emerald-r1": "deepseek-ai/DeepSeek-R1-Distill-Llama-8B"}


def _with_family(spark, folder):
    named = F.coalesce(F.create_map(*[F.lit(x) for p in _FAMILY.items() for x in p])[F.col("model")], F.col("model"))
    return deliveries(spark, folder).withColumn("family", A.family(named))


_FAMILY_SQL = "CASE model WHEN 'argon-8b' THEN 'plain' WHEN 'basalt-mini' THEN 'reasoning' WHEN 'cobalt-chat' THEN 'bilingual' WHEN 'emerald-r1' THEN 'thinking' ELSE 'plain' END"


@register(f"SELECT family, count(*) AS n FROM (SELECT {_FAMILY_SQL} AS family FROM {SPEECH_SQL}) GROUP BY family")
def adapter_dispatch(spark, folder):
    return _with_family(spark, folder).select("task_id", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@register(None)
def adapter_extract(spark, folder):
    return _with_family(spark, folder).select("task_id", A.answer_or_raw(F.col("family"), F.col("text")).alias("answer")).distinct()


def _sql_any(x: str, phrases: list[str]) -> str:
    return f"len(list_filter({sql_list(phrases)}, lambda p: contains({x}, p))) > 0"


@register(
    f"""SELECT task_id, CASE WHEN output_tokens < 10 THEN 'insufficient_output' WHEN coalesce(length(text), 0) = 0 THEN NULL
 WHEN family = 'thinking' AND {_sql_any('lower(text)', [x.lower() for x in A.REFUSE_THINKING])} THEN 'explicit_refusal'
 WHEN family = 'bilingual' AND {_sql_any(sql_strip('substring(text, 1, 200)'), A.REFUSE_BILINGUAL)} THEN 'explicit_refusal'
 WHEN family = 'plain' AND {_sql_any(sql_strip('substring(text, 1, 200)'), A.REFUSE_PLAIN)} THEN 'explicit_refusal' END AS reason
 FROM (SELECT *, {_FAMILY_SQL} AS family FROM {SPEECH_SQL}) WHERE family <> 'reasoning'"""
)
def adapter_refusal(spark, folder):
    rows = _with_family(spark, folder).where("family <> 'reasoning'")
    return rows.select("task_id", A.family_refusal(F.col("family"), F.col("text"), F.col("output_tokens")).alias("reason")).distinct()


@register(None)
def adapter_refusal_reasoning(spark, folder):
    rows = _with_family(spark, folder).where("family = 'reasoning'")
    return rows.select("task_id", A.family_refusal(F.col("family"), F.col("text"), F.col("output_tokens")).alias("reason")).distinct()


_KEYWORD_SQL = f"array_to_string(list_filter({sql_list(T.KEYWORDS)}, lambda p: contains(lower({_WINDOW_SQL}), lower(p)))[1:3], ', ')"


@register(
    f"""SELECT task_id, provider, CASE WHEN finish_reason = 'content_filter' THEN 'content_filter' WHEN coalesce(length(text), 0) = 0 AND provider <> 'open' THEN 'empty_response'
 WHEN coalesce(length(text), 0) = 0 THEN NULL WHEN provider = 'brief' AND output_tokens < 20 THEN 'incomplete_response: only ' || output_tokens || ' tokens'
 ELSE 'keywords: ' || nullif({_KEYWORD_SQL}, '') END AS reason
 FROM (SELECT *, CASE task_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'brief' ELSE 'strict' END AS provider FROM {SPEECH_SQL})"""
)
def provider_refusal(spark, folder):
    kind = F.when(F.col("task_id") % 3 == 0, "open").when(F.col("task_id") % 3 == 1, "brief").otherwise("strict")
    rows = deliveries(spark, folder).withColumn("provider", kind)
    return rows.select("task_id", "provider", A.provider_refusal(F.col("provider"), F.col("text"), F.col("output_tokens"), F.col("finish_reason")).alias("reason")).distinct()


@register(f"SELECT doc_id FROM documents WHERE coalesce(length({sql_strip('text')}), 0) > 0")
def valid_text(spark, folder):
    return table(spark, folder, "documents").where(metrics.valid_text(F.col("text"))).select("doc_id")


@register("SELECT doc_id FROM documents WHERE length(text) > 0")
def non_empty_text(spark, folder):
    return table(spark, folder, "documents").where(metrics.non_empty(F.col("text"))).select("doc_id")


@register(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{STRIP}+'), lambda w: w <> '')) AS words, substring(text, 1, 20) AS head FROM documents")
def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), T.first_characters(F.col("text"), 20).alias("head"))


@register(
    """SELECT DISTINCT original_idx, t.turn, t.role, t.content FROM (SELECT original_idx, unnest([{'turn': 0, 'role': 'system', 'content': 'Answer Yes or No.'},
 {'turn': 1, 'role': 'user', 'content': 'Text: ' || substring(text, 1, 1500)}, {'turn': 2, 'role': 'assistant', 'content': CASE WHEN split_label = 1 THEN 'Yes' ELSE 'No' END}]) AS t
 FROM personahate_train_balanced_6judge WHERE length(text) > 0)"""
)
def sft_messages(spark, folder):
    rows = table(spark, folder, "personahate_train_balanced_6judge").where(metrics.non_empty(F.col("text")))
    made = T.classification_messages(F.col("text"), F.col("split_label"), "Answer Yes or No.")
    return rows.select("original_idx", F.posexplode(made).alias("turn", "message")).select("original_idx", "turn", "message.role", "message.content").distinct()
