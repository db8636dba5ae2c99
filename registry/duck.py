"""DuckDB SQL for the registered queries, built from shared common tables.

Written from the rules, not from the Spark code: texts are joined and ranked here,
where Spark compares fingerprints.
"""

from __future__ import annotations

from convq import schema
from convq.functions import rules

EPOCH = "timestamp '2023-06-15 00:00:00'"
W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNICODE_SPACE = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{M}\p{N}_"

VIEWS = {
    "conv": f"""
        select conv_id as conversation_id, turn as message_id, text,
               case role when 'user' then 'HUMAN_TO_AI' when 'assistant' then 'AI_TO_HUMAN'
                    else 'SYSTEM' end as type,
               {EPOCH} + to_hours(((conv_id*37)%640)*24 + conv_id%24 + turn*5) as sent_at
        from conversations""",
    "doc": f"""
        select c as conversation_id, doc_id as message_id, text,
               case when doc_id % 2 = 0 then 'HUMAN_TO_AI' else 'AI_TO_HUMAN' end as type,
               {EPOCH} + to_hours(((c*37)%640)*24 + doc_id - c*c) as sent_at
        from (select *, cast(floor(sqrt(doc_id)) as bigint) as c from documents)""",
    "pairs": f"""
        select doc_id as conversation_id, cast(t.turn as bigint) as message_id,
               case when t.turn = 0 then substr(text, 1, h) else substr(text, h + 1) end as text,
               case when t.turn = 0 then 'HUMAN_TO_AI' else 'AI_TO_HUMAN' end as type,
               {EPOCH} + to_hours(((doc_id*37)%640)*24 + doc_id%24 + t.turn*5) as sent_at
        from (select *, cast(floor(length(text)/2.0) as int) as h from documents)
             cross join (values (0),(1)) as t(turn)""",
}
VERDICTS = """
    select d.doc_id as conversation_id,
           case when l.quality = 1 then 6 else 1 end + cast(d.doc_id % 5 as int) as quality,
           l.toxic = 0 as is_safe, d.text like '%@%' as contains_pii,
           d.doc_id % 7 = 0 as contains_sensitive_content,
           case cast(d.doc_id % 3 as int) when 0 then 'high' when 1 then 'medium' else 'low' end
               as response_accuracy,
           d.lang as language
    from documents d join labels l on d.doc_id = l.doc_id"""

# ---- fixed values: dates, names, word lists ----
START, END = "timestamp '2023-07-01'", "timestamp '2025-01-31'"
BUCKETS = schema.TIME_BUCKETS
BUCKET_TABLE = (
    "buckets as (select * from (values "
    + ", ".join(f"('{q}', date '{a}', date '{b}')" for q, a, b in BUCKETS)
    + ") as b(time_bucket, start_date, end_date))"
)
# the judge's prompt, here as the check's own statement of it
PROMPT_HEAD = """You are an expert conversation evaluator for large language model training. Your task is to analyze conversations between users and AI assistants to determine their suitability for LLM fine-tuning.

IMPORTANT: Your response MUST be a valid JSON object. Do not include backticks, markdown code block markers, or any other text outside the JSON object.

[CONVERSATION]
"""
PROMPT_TAIL = """
[END CONVERSATION]

Evaluate this conversation and return a JSON object with these fields:

- quality (integer 1-10): The overall quality of the conversation for fine-tuning.
- topic (string): The main subject from the provided list.
- summary (string): A concise 10-20 word description.
- classification_reasoning (string): Brief reasoning for the quality and safety classifications.
- contains_pii (boolean): True if PII is present.
- contains_sensitive_content (boolean): True if PHI or other sensitive topics are present.
- is_safe (boolean): True if the conversation contains NO harmful material.
- response_accuracy (string): "high" | "medium" | "low".
- ai_assistant_is_wrong (boolean): True if the assistant is clearly incorrect.
- language (string): The primary language used."""
# ---- end of fixed values; names and word lists are stated once, in schema and rules ----
ISSUES, MAJOR, LOW = schema.ISSUES, schema.MAJOR_ISSUES, schema.LOW_QUALITY_ISSUES
MESSAGE_FLAGS = rules.FLAGS
TERMS = "|".join(term for group in rules.OFFENSIVE_TERMS for term in group)
PROMO, EXTRA = "|".join(rules.PROMO), "|".join(rules.PROMO_EXTRA)


def in_range(column: str = "sent_at") -> str:
    return f"{column} >= {START} and {column} <= {END}"


def length_category(n: str) -> str:
    return (
        f"case when {n} between 1 and 2 then 'one_off' when {n} between 3 and 5 then 'short' "
        f"when {n} between 6 and 20 then 'medium' when {n} >= 21 then 'long' else 'unknown' end"
    )


def time_bucket(at: str) -> str:
    """Label by lookup over the seven date ranges."""
    cases = " ".join(
        f"when cast({at} as date) between date '{a}' and date '{b}' then '{q}'" for q, a, b in BUCKETS
    )
    return f"case {cases} else 'unknown' end"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{W}]+|[{W}]+$', '', 'g')"


def without(t: str, cls: str) -> str:
    return f"length(regexp_replace({t}, '{cls}', '', 'g'))"


def bounded(alternatives: str) -> str:
    return f"(?i)(^|[^{WORD}])({alternatives})([^{WORD}]|$)"


def ratio(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0.0 else cast({a} as double) / {b} end"


def message_ctes(view: str, source: str | None = None) -> str:
    """m (messages), s (stripped, normalised), st (character counts)."""
    return f"""
    m as ({source or VIEWS[view]}),
    s as (select * replace (coalesce(text, '') as text),
                 {strip("coalesce(text, '')")} as stripped,
                 lower({strip("coalesce(text, '')")}) as norm from m),
    st as (select *, length(text) as n_chars, {without('text', '[^\\p{L}]')} as n_alpha,
                  {without('text', '[^\\x00-\\x7f]')} as n_ascii,
                  length(text) - {without('text', '[aeiouAEIOU]')} as n_vowel,
                  {without('text', f'[^\\p{{L}}{W}]')} as n_text from s)"""


def flag_ctes(view: str, classic: bool = False, source: str | None = None) -> str:
    """... and f: the ten stateless message flags."""
    price_dollar = rf"[{WORD}]\$\p{{Nd}}{{2,}}([^{WORD}]|$)"
    percent = r"\p{Nd}{2,}% (off|discount)"
    if classic:
        too_long = "length(text) >= 1000 and length(text) - length(replace(text, ' ', '')) + 1 > 1000"
        spam = (
            "(contains(lower(text), 'free') and contains(lower(text), 'click')) or "
            f"(regexp_matches(text, '{bounded(PROMO)}') and (regexp_matches(text, '{price_dollar}') "
            f"or regexp_matches(text, '{bounded(percent + '|' + EXTRA)}')))"
        )
        non_conv = (
            "length(norm) = 1 or not regexp_matches(norm, '[\\p{L}\\p{N}]') "
            f"or regexp_matches(norm, '^[\\p{{Nd}}{UNICODE_SPACE}()\\-]+$')"
        )
        encoding = ""
    else:
        too_long = f"length(text) >= 2000 and len(list_filter(regexp_split_to_array(text, '[{W}]+'), lambda x: x <> '')) > 500"
        spam = (
            f"regexp_matches(text, '{bounded(PROMO + '|' + EXTRA)}') and "
            f"(regexp_matches(text, '{price_dollar}') or regexp_matches(text, '{bounded(percent)}'))"
        )
        non_conv = "text = '' or length(norm) = 1 or (norm <> '' and n_alpha = 0)"
        encoding = f" or ({ratio('n_ascii', 'n_chars')} < 0.5 and {ratio('n_alpha', 'n_chars')} > 0.7)"
    return message_ctes(view, source) + f""",
    f as (select *,
        stripped = '' as empty,
        length(stripped) < 2 as too_short,
        ({too_long}) as too_long,
        (n_chars < 3 or {ratio('n_alpha', 'n_chars')} < 0.3
         or (n_alpha > n_vowel and cast(n_vowel as double) / nullif(n_alpha - n_vowel, 0) < 0.1)
         or case when contains(text, ' ') then regexp_matches(text, '[^{W}]{{21}}') else n_chars > 20 end
         or len(list_filter(list_distinct(string_split(text, '')),
                lambda c: c <> chr(10) and contains(text, repeat(c, 10)))) > 0) as gibberish,
        {ratio('n_text', 'n_chars')} < 0.5 as non_text_heavy,
        (length(lower(text)) >= 3 and regexp_matches(lower(text), '{bounded(TERMS)}')) as offensive,
        ({spam}) as spam,
        ({non_conv}) as non_conversational,
        (contains(text, chr(65533) || chr(65533))
         or regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]')
         or regexp_matches(text, '\\\\u[0-9a-fA-F]{{4}}'){encoding}) as encoding_issues,
        {ratio('n_ascii', 'n_chars')} < 0.8 as language_issues
        from st)"""


def conversation_ctes(
    view: str, classic: bool = False, scope: str = "shared", source: str | None = None
) -> str:
    """... and c: the fourteen conversation flags with size, first time and usable."""
    joined = "text" if classic else "stripped"
    gate = "false" if classic else "(empty or too_short or single_turn)"
    empty = (
        f"length({strip('joined')}) < 10 or n_meaningful = 0"
        if classic
        else "n_stripped < 10 or n_meaningful = 0"
    )
    checked = "true" if classic else f"not {gate}"
    blank = "true" if classic else "t <> ''"
    messages = (
        f"""union all
        select conversation_id, 1, sent_at, message_id, norm from s
        semi join (select conversation_id from g where {checked}) using (conversation_id)"""
        if scope == "shared"
        else ""
    )
    shares = {
        "gibberish": 0.5, "non_text_heavy": 0.5, "encoding_issues": 0.3, "language_issues": 0.5,
        "non_conversational": 0.7,
    }
    masked = {"encoding_issues": "false"}
    share_sql = ",\n".join(
        f"case when {gate} then {masked.get(k, 'empty')} else n_{k} / cast(message_count as double) > {v} end as x_{k}"
        for k, v in shares.items()
    )
    counts = ",\n".join(f"count(*) filter (where {k}) as n_{k}" for k in [*shares, "offensive", "spam"])
    low = " + ".join(f"cast({k} as int)" for k in LOW)
    major = " or ".join(MAJOR)
    return flag_ctes(view, classic, source) + f""",
    agg as (select conversation_id, count(*) as message_count, min(sent_at) as first_sent_at,
                   sum(length(stripped)) as n_stripped,
                   count(*) filter (where length(stripped) >= 3) as n_meaningful,
                   string_agg({joined}, ' ' order by sent_at, message_id) as joined,
                   {counts}
            from f group by conversation_id),
    rep as (select distinct conversation_id from (
              select conversation_id, norm from s where length(norm) > 6
              group by all having count(*) >= 3)),
    g as (select agg.*, rep.conversation_id is not null as repetitive_spam,
                 message_count = 1 as single_turn, message_count > 50 as too_long,
                 n_meaningful < 2 as too_short, ({empty}) as empty
          from agg left join rep using (conversation_id)),
    occ as (select conversation_id, 0 as kind, null::timestamp as sent_at, null::bigint as message_id,
                   lower({strip('joined')}) as t from g
            {messages}),
    ranked as (select *, row_number() over (partition by t
                   order by conversation_id, kind, sent_at, message_id) > 1 as duplicate
               from occ where {blank}),
    h as (select g.*, coalesce(r.duplicate, false) as duplicate, {share_sql},
                 not {gate} and n_offensive > 0 as offensive, not {gate} and n_spam > 0 as spam
          from g left join (select conversation_id, duplicate from ranked where kind = 0) r
               using (conversation_id)),
    h2 as (select conversation_id, message_count, first_sent_at, empty, too_short, too_long,
                  duplicate, x_gibberish as gibberish, x_non_text_heavy as non_text_heavy,
                  offensive, spam, x_non_conversational as non_conversational,
                  x_encoding_issues as encoding_issues, x_language_issues as language_issues,
                  single_turn, repetitive_spam from h),
    h3 as (select *, {low} >= 3 as low_quality from h2),
    c as (select *, not ({major}) as usable, {length_category('message_count')} as length_category,
                 {time_bucket('first_sent_at')} as time_bucket from h3)"""


def rollup_ctes(view: str) -> str:
    """m, r (rollup of the messages in range), two (its two-sided conversations)."""
    return f"""
    m as ({VIEWS[view]}),
    r as (select conversation_id, count(*) as message_count,
                 count(*) filter (where type = 'HUMAN_TO_AI') as human_count,
                 count(*) filter (where type = 'AI_TO_HUMAN') as ai_count,
                 min(sent_at) as first_sent_at,
                 cast(coalesce(sum(length(text)), 0) as bigint) as total_chars
          from m where {in_range()} group by conversation_id),
    two as (select *, {length_category('message_count')} as length_category from r
            where human_count >= 1 and ai_count >= 1)"""


def metrics_ctes(view: str, **kw) -> str:
    counts = ", ".join(f"count(*) filter (where {k}) as {k}" for k in ISSUES)
    return conversation_ctes(view, **kw) + f""",
    q as (select count(*) as total_conversations,
                 cast(coalesce(sum(message_count), 0) as bigint) as total_messages, {counts},
                 count(*) filter (where usable) as usable from c)"""


def reported(q: str = "") -> str:
    subtracted = " + ".join(q + k for k in ISSUES if k != "too_long")
    return (
        f"(case when {q}total_conversations = 0 then 0.0 else "
        f"cast({q}total_conversations - ({subtracted}) as double) / {q}total_conversations * 100 end)"
    )


def segment_ctes(view: str, **kw) -> str:
    counts = ", ".join(f"count(*) filter (where {k}) as {k}" for k in ISSUES)
    percentages = ", ".join(
        f"round_even({k} * 100.0::double / total_conversations, 1) as {k}_pct" for k in ISSUES
    )
    return conversation_ctes(view, **kw) + f""",
    seg0 as (select length_category, time_bucket, count(*) as total_conversations,
                    count(*) filter (where usable) as usable, {counts}
             from c group by all),
    seg as (select *, round_even(usable * 100.0::double / total_conversations, 1) as usable_percentage,
                   {percentages} from seg0)"""


def token_ctes(view: str) -> str:
    return rollup_ctes(view) + """,
    tok as (select conversation_id, length_category, date_trunc('quarter', first_sent_at) as time_quarter,
                   message_count, total_chars + message_count - 1 as char_count,
                   (total_chars + message_count - 1) // 4 as token_count
            from two where length_category in ('short', 'medium', 'long')),
    tstats as (select length_category, count(token_count) as token_count_count,
                 round_even(avg(token_count), 2) as token_count_mean,
                 round_even(stddev_samp(token_count), 2) as token_count_std,
                 min(token_count) as token_count_min, max(token_count) as token_count_max,
                 cast(sum(token_count) as bigint) as token_count_sum,
                 round_even(avg(char_count), 2) as char_count_mean,
                 round_even(stddev_samp(char_count), 2) as char_count_std,
                 round_even(avg(message_count), 2) as message_count_mean,
                 round_even(stddev_samp(message_count), 2) as message_count_std
               from tok group by length_category),
    price as (select length_category, token_count_sum as total_tokens,
                 token_count_count as total_conversations,
                 token_count_sum / 1000000.0::double as tokens_millions,
                 token_count_sum / 1000000.0::double
                     * (0.55::double * 1.2::double * 0.9::double + 2.19::double * 1.2::double * 0.1::double)
                     as estimated_cost_usd,
                 token_count_sum / cast(token_count_count as double) as avg_tokens_per_conversation
              from tstats)"""


def order_hash(seed: int, *ids: str) -> str:
    parts = ", ".join(f"cast({i} as varchar)" for i in ids)
    return f"md5(concat_ws(':', {parts}, '{seed}'))"


def below_rate(seed: int, rate: float, *ids: str) -> str:
    return f"cast('0x' || substr({order_hash(seed, *ids)}, 1, 8) as bigint) / 4294967296.0::double < {rate}::double"
