"""One registered query per operator, next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from convq.functions import judge, rules
from convq.functions import text as tx
from convq.functions import tokens as tk
from convq.functions.rules import CLASSIC
from convq.operators import costs, joins, quality, reports, rollup, sampling, transcripts
from convq.operators import duplicates as dup
from convq.operators import filters as f
from convq.plans.filter_judge import filter_and_judge
from convq.plans.incremental import MetricsStore
from convq.plans.judge_run import JudgeRun
from convq.plans.quality_run import classic_run, stored_run, stratified_run
from convq.plans.token_cost import token_cost_run
from convq.sources import messages as msg
from convq.sources import sinks, store, views
from convq.sources.store import MessageStore
from convq.sources.workspace import stored, work_folder
from convq.streaming import streams
from registry import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEW = {"conv": views.conv_messages, "doc": views.doc_messages, "pairs": views.doc_pairs}
SEED = sampling.SEED
FIRST_PULL_END = "2024-06-30"  # an earlier pull stopped here


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on(view: str, operator: Callable[..., DataFrame], *args, **kw):
    """The operator over one of the message views."""
    return lambda spark, sf: operator(VIEW[view](spark, sf), *args, **kw)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums in another order differ in the last bits."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def then(query, *steps):
    def run(spark, sf):
        df = query(spark, sf)
        for step in steps:
            df = step(df)
        return df

    return run


def with_sql(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"


# ------------------------------------------------------------------ sources


def _message_view(spark, sf):
    raw = views.conv_messages(spark, sf).select(
        F.col("conversation_id").alias("CONVERSATIONID"),
        F.col("text").alias("TEXT"),
        F.col("sent_at").alias("SENTAT"),
        F.col("type").alias("TYPE"),
        F.col("message_id").alias("ID"),
    )
    names = {"conversation_id": "conversationid", "sent_at": "sentat", "message_id": "id"}
    return msg.message_view(raw, names)


add(
    "message_view",
    _message_view,
    with_sql(
        f"m as ({duck.VIEWS['conv']})",
        "select conversation_id, coalesce(text, '') as text, sent_at, type, message_id from m",
    ),
)
METADATA = "select conversation_id, message_count, first_sent_at as first_message_date from two"
for name in ("conv", "doc"):
    add(
        f"conversation_metadata_{name}",
        on(name, rollup.conversation_metadata),
        with_sql(duck.rollup_ctes(name), METADATA),
    )


def _earlier_store(spark, sf, view="conv") -> MessageStore:
    """A store whose last refresh ended earlier than the data does."""
    kept = MessageStore(spark, work_folder(spark, "store"))
    kept.refresh(VIEW[view](spark, sf), end=FIRST_PULL_END)
    return kept


EARLIER = f"""
    early as (select conversation_id from m
              where sent_at >= {duck.START} and sent_at <= timestamp '{FIRST_PULL_END}'
              group by 1 having count(*) filter (where type = 'HUMAN_TO_AI') >= 1
                            and count(*) filter (where type = 'AI_TO_HUMAN') >= 1),
    kept as (select m.*, timestamp '{FIRST_PULL_END}' as upto from m semi join early using (conversation_id)
             where sent_at >= {duck.START} and sent_at <= timestamp '{FIRST_PULL_END}')"""


def _whole_store(spark, sf) -> MessageStore:
    kept = MessageStore(spark, work_folder(spark, "store"))
    kept.refresh(VIEW["conv"](spark, sf))
    return kept


add(
    "materialize_messages",
    lambda spark, sf: _whole_store(spark, sf).messages(),
    with_sql(
        duck.rollup_ctes("conv"),
        f"select * from m where {duck.in_range()} and conversation_id in (select conversation_id from two)",
    ),
)


def _incremental(spark, sf):
    kept = _earlier_store(spark, sf)
    source = VIEW["conv"](spark, sf)
    kept.refresh(source)
    kept.refresh(source)  # nothing is pending any more
    return kept.messages()


add(
    "incremental_pull",
    _incremental,
    with_sql(
        duck.rollup_ctes("conv") + "," + EARLIER,
        f"""select * exclude (upto) from kept union all
            select * from m where {duck.in_range()}
              and conversation_id in (select conversation_id from two)
              and conversation_id not in (select conversation_id from early)""",
    ),
)


def _status(spark, sf):
    kept = _earlier_store(spark, sf)
    kept.save_metadata(rollup.conversation_metadata(VIEW["conv"](spark, sf)))
    return rounded(kept.status())


add(
    "store_status",
    _status,
    with_sql(
        duck.rollup_ctes("conv") + "," + EARLIER,
        """select (select count(*) from two) as total_conversations,
                  (select count(*) from two semi join early using (conversation_id)) as stored,
                  (select count(*) from two anti join early using (conversation_id)) as remaining,
                  (select count(*) from kept) as total_messages,
                  round((select count(*) from two semi join early using (conversation_id)) * 100.0::double
                        / (select count(*) from two), 6) as progress_pct""",
    ),
)


def _pending(spark, sf):
    m = VIEW["conv"](spark, sf)
    stored = rollup.conversation_metadata(m, end=FIRST_PULL_END)
    return joins.pending(rollup.conversation_metadata(m), stored)


add(
    "pending_anti_join",
    _pending,
    with_sql(
        duck.rollup_ctes("conv") + "," + EARLIER,
        METADATA + " anti join early using (conversation_id)",
    ),
)


add(
    "read_stored",
    lambda spark, sf: _whole_store(spark, sf).stored_ids(),
    with_sql(duck.rollup_ctes("conv"), "select conversation_id from two"),
)


def _metadata_join(spark, sf):
    m = VIEW["conv"](spark, sf)
    return joins.metadata_messages(rollup.conversation_metadata(m), f.date_range_filter(m))


add(
    "metadata_messages_join",
    _metadata_join,
    with_sql(
        duck.rollup_ctes("conv"),
        f"""select conversation_id, message_count, first_sent_at as first_message_date, message_id,
                   text, type, sent_at
            from two join m using (conversation_id) where {duck.in_range()}""",
    ),
)



def _pulled_by_id(spark, sf):
    """The copy in buckets, made anew after a second pull."""
    kept = _earlier_store(spark, sf)
    kept.compact(buckets=4)
    kept.refresh(VIEW["conv"](spark, sf))
    kept.compact(buckets=8)
    return kept


add("incremental_pull_by_id", lambda spark, sf: _pulled_by_id(spark, sf).by_id()[1], ORACLES["incremental_pull"])
add(
    "metadata_messages_by_id",
    lambda spark, sf: joins.metadata_messages(*_pulled_by_id(spark, sf).by_id()),
    with_sql(
        duck.rollup_ctes("conv") + "," + EARLIER,
        f"""select conversation_id, message_count, first_sent_at as first_message_date, message_id, text, type, sent_at
            from two join (select * exclude (upto) from kept union all
                select * from m where {duck.in_range()} and conversation_id not in (select conversation_id from early))
            using (conversation_id)""",
    ),
)

# ------------------------------------------- filters, labels and sampling

for name in ("conv", "doc"):
    view = duck.VIEWS[name]
    add(
        f"date_range_filter_{name}",
        on(name, f.date_range_filter),
        f"select * from ({view}) where {duck.in_range()}",
    )
add(
    "date_range_whole_last_day",
    on("conv", f.date_range_filter, end_inclusive_day=True),
    f"select * from ({duck.VIEWS['conv']}) where sent_at >= {duck.START} and sent_at < timestamp '2025-02-01'",
)
add(
    "two_sided_filter",
    on("conv", rollup.two_sided_conversations),
    with_sql(duck.rollup_ctes("conv"), "select * exclude (length_category) from two"),
)
for label, low, high in [("one_off", 1, 2), ("short", 3, 5), ("medium", 6, 20), ("long", 21, 999)]:
    add(
        f"length_range_filter_{label}",
        then(
            on("doc", rollup.two_sided_conversations),
            lambda df, label=label: f.length_range_filter(df, label, 999),
        ),
        with_sql(
            duck.rollup_ctes("doc"),
            f"select * exclude (length_category) from two where message_count between {low} and {high}",
        ),
    )
add(
    "length_category",
    then(
        on("doc", rollup.conversation_rollup),
        lambda df: df.select(
            "conversation_id", "message_count", f.length_category(F.col("message_count")).alias("length_category")
        ),
    ),
    f"""select conversation_id, count(*) as message_count, {duck.length_category('count(*)')} as length_category
        from ({duck.VIEWS['doc']}) group by conversation_id""",
)
for name in ("conv", "pairs"):
    add(
        f"time_bucket_{name}",
        then(
            on(name, lambda m: m),
            lambda df: df.select(
                "conversation_id", "message_id", f.time_bucket(F.col("sent_at")).alias("time_bucket")
            ),
        ),
        f"select conversation_id, message_id, {duck.time_bucket('sent_at')} as time_bucket from ({duck.VIEWS[name]})",
    )
add(
    "time_bucket_bounds",
    on("pairs", f.bucket_bounds),
    f"""with {duck.BUCKET_TABLE} select * from buckets where time_bucket in
        (select {duck.time_bucket('sent_at')} from ({duck.VIEWS['pairs']}))""",
)
add(
    "quarter_trunc",
    then(
        on("conv", rollup.two_sided_conversations),
        lambda df: df.select("conversation_id", F.date_trunc("quarter", "first_sent_at").alias("time_quarter")),
    ),
    with_sql(
        duck.rollup_ctes("conv"),
        "select conversation_id, cast(date_trunc('quarter', first_sent_at) as timestamp) as time_quarter from two",
    ),
)
add(
    "random_conversations",
    on("pairs", sampling.random_conversations, 100),
    f"""select conversation_id from (select distinct conversation_id from ({duck.VIEWS['pairs']}))
        order by {duck.order_hash(SEED, 'conversation_id')}, conversation_id limit 100""",
)
add(
    "percent_sample",
    on("pairs", sampling.percent_sample, 0.1),
    f"""select distinct conversation_id from ({duck.VIEWS['pairs']})
        where {duck.below_rate(SEED, 0.1, 'conversation_id')}""",
)
add(
    "percent_sample_by_message",
    on("doc", sampling.percent_sample, 0.05, by="message"),
    f"""select distinct conversation_id from ({duck.VIEWS['doc']})
        where {duck.below_rate(SEED, 0.05, 'conversation_id', 'message_id')}""",
)


def _stratified_sql(view: str, target: int) -> str:
    return f"""with {duck.BUCKET_TABLE}, m as ({duck.VIEWS[view]}),
    inside as (select conversation_id, time_bucket, count(*) as n from m join buckets
               on sent_at >= start_date and sent_at <= end_date group by all
               having count(*) filter (where type = 'HUMAN_TO_AI') >= 1
                  and count(*) filter (where type = 'AI_TO_HUMAN') >= 1),
    ranked as (select *, {duck.length_category('n')} as length_category, row_number() over (
                 partition by time_bucket, length_category
                 order by {duck.order_hash(SEED, 'conversation_id')}, conversation_id) as rank
               from inside)
    select conversation_id, time_bucket, length_category from ranked where rank <= {target // 28}"""


for name, target in (("conv", 56), ("pairs", 840), ("doc", 28)):
    add(
        f"stratified_sample_{name}",
        on(name, sampling.stratified_sample, target),
        _stratified_sql(name, target),
    )


def _transcripts_sql(view: str, n: int | None = None) -> str:
    return f"""m as ({duck.VIEWS[view]}),
    first as (select *, row_number() over (partition by conversation_id order by sent_at, message_id) as position from m),
    t as (select conversation_id, string_agg(coalesce(type, '') || ': ' || coalesce(text, ''), chr(10)
                 order by sent_at, message_id) as full_conversation
          from first {f"where position <= {n}" if n else ""} group by conversation_id),
    a as (select *, length(full_conversation) as n,
                 cast({duck.without('full_conversation', '[^\\p{L}]')} as double) / length(full_conversation) as alpha
          from t)"""


AUTHORED = on("doc", transcripts.transcript_authored)


def _kept_parts(view: str, keep: Callable[[DataFrame], DataFrame]):
    """Decided on counts; texts of the kept conversations come in parts, one each at these sizes."""

    def run(spark, sf):
        m = VIEW[view](spark, sf)
        return transcripts.parts_of(m, keep(transcripts.authored_counts(m))).drop("part")

    return run


add(
    "min_chars_filter",
    _kept_parts("pairs", f.min_chars_filter),
    with_sql(_transcripts_sql("pairs"), "select conversation_id, full_conversation from a where n >= 50"),
)
add(
    "alpha_ratio_filter",
    _kept_parts("pairs", f.alpha_ratio_filter),
    with_sql(_transcripts_sql("pairs"), "select conversation_id, full_conversation from a where alpha >= 0.7"),
)
for name in ("conv", "pairs"):
    add(
        f"prefilter_funnel_{name}",
        then(on(name, transcripts.authored_counts), f.prefilter_funnel),
        with_sql(
            _transcripts_sql(name),
            """select count(*) as initial, count(*) filter (where n < 50) as removed_short,
                      count(*) filter (where n >= 50 and alpha < 0.7) as removed_gibberish,
                      count(*) filter (where n >= 50 and alpha >= 0.7) as final from a""",
        ),
    )
add(
    "first_15_messages",
    on("doc", transcripts.first_messages),
    with_sql(_transcripts_sql("doc", 15), "select * from first where position <= 15"),
)

# -------------------------------------------------------------------- joins


def _sampled(spark, sf):
    m = VIEW["pairs"](spark, sf)
    return joins.sampled_messages(m, sampling.random_conversations(m, 100))


add(
    "sampled_messages",
    _sampled,
    f"""with m as ({duck.VIEWS['pairs']}), ids as ({ORACLES['random_conversations']})
        select m.* from m join ids using (conversation_id)""",
)


def _fetched(spark, sf):
    m = VIEW["doc"](spark, sf)
    return joins.fetch_by_ids(m, sampling.percent_sample(m, 0.5))


add(
    "fetch_by_ids",
    _fetched,
    f"with m as ({duck.VIEWS['doc']}) select * from m where {duck.below_rate(SEED, 0.5, 'conversation_id')}",
)


def _fetched_heavy(spark, sf):
    """The same with the conversations of a hundred messages or more left in place."""
    m = VIEW["doc"](spark, sf)
    return joins.fetch_by_ids(m, sampling.percent_sample(m, 0.5), joins.heavy_ids(m, 100))


def _sampled_heavy(spark, sf):
    m = VIEW["doc"](spark, sf)
    metadata = rollup.conversation_metadata(m)
    return joins.metadata_messages(metadata, f.date_range_filter(m), joins.heavy_ids(m, 20))


add("fetch_by_ids_heavy", _fetched_heavy, ORACLES["fetch_by_ids"])
add(
    "metadata_messages_heavy",
    _sampled_heavy,
    with_sql(
        duck.rollup_ctes("doc"),
        f"""select conversation_id, message_count, first_sent_at as first_message_date, message_id,
                   text, type, sent_at
            from two join m using (conversation_id) where {duck.in_range()}""",
    ),
)
add(
    "in_group_having",
    on("conv", joins.in_group_having),
    with_sql(
        duck.rollup_ctes("conv"),
        f"select * from m where {duck.in_range()} and conversation_id in (select conversation_id from two)",
    ),
)
add("ordered_messages", on("doc", joins.ordered_messages), duck.VIEWS["doc"])

# ----------------------------------------------------- rollups and volumes

for name in ("conv", "doc", "pairs"):
    add(
        f"conversation_rollup_{name}",
        on(name, lambda m: rollup.conversation_rollup(f.date_range_filter(m))),
        with_sql(duck.rollup_ctes(name), "select * from r"),
    )
    add(
        f"length_stats_{name}",
        then(on(name, rollup.length_stats), rounded),
        with_sql(
            duck.rollup_ctes(name),
            """select count(*) as n_conversations, min(message_count) as min_messages,
                      max(message_count) as max_messages, round(avg(message_count), 6) as mean_messages,
                      round(median(message_count), 6) as median_messages from two""",
        ),
    )
    add(
        f"length_histogram_{name}",
        then(on(name, rollup.length_histogram), rounded),
        with_sql(
            duck.rollup_ctes(name),
            """, e as (select case when min(message_count) = max(message_count) then min(message_count) - 0.5 else min(message_count) end::double as lo,
                            case when min(message_count) = max(message_count) then max(message_count) + 0.5 else max(message_count) end::double as hi
                     from two),
            b as (select cast(i as int) as bin from range(50) r(i)),
            p as (select cast(least(floor((message_count - lo) * 50 / (hi - lo)), 49) as int) as bin, count(*) as n
                  from two, e group by 1)
            select bin, round(lo + bin * (hi - lo) / 50, 6) as bin_start,
                   round(lo + (bin + 1) * (hi - lo) / 50, 6) as bin_end, coalesce(n, 0) as n_conversations
            from b cross join e left join p using (bin) where lo is not null""",
        ),
    )
    add(
        f"totals_by_class_and_quarter_{name}",
        on(name, rollup.totals_by_class_and_quarter),
        with_sql(
            duck.rollup_ctes(name),
            f"""select length_category, {duck.time_bucket('first_sent_at')} as time_bucket,
                       count(*) as n_conversations, cast(sum(message_count) as bigint) as n_messages,
                       cast(sum(total_chars) as bigint) as n_chars from two group by 1, 2""",
        ),
    )
for name in ("conv", "doc"):
    add(
        f"distinct_conversations_{name}",
        on(name, rollup.distinct_conversations),
        f"select count(distinct conversation_id) as n_conversations from ({duck.VIEWS[name]}) where {duck.in_range()}",
    )
    add(
        f"length_distribution_{name}",
        then(on(name, rollup.length_distribution), rounded),
        with_sql(
            duck.rollup_ctes(name),
            """, k as (select unnest(['one_off', 'short', 'medium', 'long']) as length_category)
            select length_category, count(c) as n_conversations,
                   round(count(c) * 100.0::double / (select count(*) from two), 6) as percentage
            from k left join (select case when message_count = 2 then 'one_off'
                 when message_count between 3 and 5 then 'short'
                 when message_count between 6 and 20 then 'medium'
                 when message_count >= 21 then 'long' end as length_category, 1 as c from two) using (length_category)
            group by length_category""",
        ),
    )
    add(
        f"totals_by_category_{name}",
        on(name, rollup.totals_by_category),
        with_sql(
            duck.rollup_ctes(name),
            """select length_category, count(*) as total_conversations from two
               where length_category <> 'one_off' group by 1""",
        ),
    )
    add(
        f"quarterly_volume_{name}",
        then(on(name, rollup.quarterly_volume), rounded),
        with_sql(
            duck.rollup_ctes(name),
            """select cast(date_trunc('quarter', first_sent_at) as timestamp) as time_quarter, length_category,
                      count(*) as total_conversations, round(avg(total_chars), 6) as avg_chars_per_convo,
                      cast(sum(total_chars) as bigint) as total_chars_in_bucket
               from two where length_category <> 'one_off' group by 1, 2""",
        ),
    )


def _approx_distinct(spark, sf):
    """Whether the estimate is within three standard deviations of the exact count."""
    m = VIEW["pairs"](spark, sf)
    both = [rollup.distinct_conversations(m, approximate=how).select(F.lit(how).alias("how"), "n_conversations") for how in (True, False)]
    counts = both[0].unionByName(both[1])
    n = lambda how: F.max(F.when(F.col("how") == how, F.col("n_conversations")))
    return counts.agg((F.abs(n(True) - n(False)) / n(False) < 3 * rollup.RSD).alias("close"), n(False).alias("n_conversations"))


add(
    "approx_distinct_conversations",
    _approx_distinct,
    f"""select true as close, count(distinct conversation_id) as n_conversations
        from ({duck.VIEWS['pairs']}) where {duck.in_range()}""",
)

RANGES = [("2023-07-01", "2025-01-31"), ("2024-01-01", "2024-03-31"), ("2024-02-10", "2024-02-10"), ("2019-01-01", "2019-12-31")]


def _approx_by_range(spark, sf):
    """Estimates of several ranges out of one table of daily sketches, and whether each is close enough."""
    m = VIEW["pairs"](spark, sf)
    sketches = stored(rollup.daily_sketches(m), "sketches")
    ranges = spark.createDataFrame(RANGES, "first_day string, last_day string")
    ranges = ranges.select(*[F.col(c).cast("date").alias(c) for c in ranges.columns])
    days = ranges.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    seen = m.select("conversation_id", F.to_date("sent_at").alias("day")).distinct()
    exact = days.join(seen, "day").groupBy("first_day", "last_day").agg(F.countDistinct("conversation_id").alias("exact"))
    both = rollup.sketched_conversations(sketches, ranges).join(exact, ["first_day", "last_day"], "left")
    n = F.coalesce("exact", F.lit(0))
    close = F.abs(F.col("n_conversations") - n) <= 3 * rollup.sketch_error() * n
    return both.select(*[F.col(c).cast("string").alias(c) for c in ranges.columns], close.alias("close"), n.alias("n_conversations"))


add(
    "approx_distinct_by_range",
    _approx_by_range,
    f"""with r(first_day, last_day) as (values {", ".join(f"('{a}', '{b}')" for a, b in RANGES)})
        select first_day, last_day, true as close,
               (select count(distinct conversation_id) from ({duck.VIEWS['pairs']}) m
                where cast(m.sent_at as date) between cast(r.first_day as date) and cast(r.last_day as date)) as n_conversations
        from r""",
)

# -------------------------------------------------------------- transcripts

for name in ("conv", "doc"):
    add(
        f"transcript_plain_{name}",
        on(name, transcripts.transcript_plain),
        f"""select conversation_id, 0::bigint as part,
                   string_agg(coalesce(text, ''), ' ' order by sent_at, message_id) as combined_text
            from ({duck.VIEWS[name]}) group by 1""",
    )
    add(
        f"transcript_authored_{name}",
        on(name, transcripts.transcript_authored, 15),
        with_sql(_transcripts_sql(name, 15), "select * from t"),
    )
add(
    "transcript_stripped",
    on("doc", transcripts.transcript_stripped),
    f"""select conversation_id, 0::bigint as part,
               string_agg({duck.strip("coalesce(text, '')")}, ' ' order by sent_at, message_id) as combined_text from ({duck.VIEWS['doc']}) group by 1""",
)
OVERSIZE = 100_000
add(
    "transcript_oversize_messages",
    on("doc", transcripts.oversize_messages, OVERSIZE),
    f"""with m as ({duck.VIEWS['doc']}) select * from m where conversation_id in
        (select conversation_id from m group by 1 having sum(length(text) + 1) > {OVERSIZE})""",
)

# ------------------------------------------------------------ message rules

add(
    "char_stats",
    then(on("doc", rules.char_stats), rounded),
    with_sql(
        duck.message_ctes("doc"),
        f"""select conversation_id, message_id, n_chars, n_alpha, n_ascii, n_vowel, n_text,
                   n_alpha - n_vowel as n_consonant,
                   round({duck.ratio('n_alpha', 'n_chars')}, 6) as alpha_ratio,
                   round({duck.ratio('n_ascii', 'n_chars')}, 6) as ascii_ratio,
                   round({duck.ratio('n_vowel', 'n_chars')}, 6) as vowel_ratio,
                   round({duck.ratio('n_text', 'n_chars')}, 6) as text_char_ratio from st""",
    ),
)
for flag in duck.MESSAGE_FLAGS:
    add(
        f"msg_{flag}",
        on("doc", quality.message_flag, flag),
        with_sql(duck.flag_ctes("doc"), f"select conversation_id, message_id, {flag} from f"),
    )
DUPLICATE = """row_number() over (partition by norm order by conversation_id, sent_at, message_id) > 1"""
add(
    "msg_duplicate",
    on("pairs", quality.message_flag, "duplicate"),
    with_sql(
        duck.message_ctes("pairs"),
        f"select conversation_id, message_id, {DUPLICATE} and norm <> '' as duplicate from s",
    ),
)
for name in ("conv", "doc", "pairs"):
    for profile in ("optimized", "classic"):
        classic = profile == "classic"
        chosen = CLASSIC if classic else rules.OPTIMIZED
        suffix = f"{name}_classic" if classic else name
        blank = "" if classic else "and norm <> ''"
        add(
            f"message_flags_{suffix}",
            on(name, quality.message_flags, chosen),
            with_sql(
                duck.flag_ctes(name, classic),
                f"""select conversation_id, message_id, {', '.join(duck.MESSAGE_FLAGS)},
                           {DUPLICATE} {blank} as duplicate from f""",
            ),
        )
        add(
            f"conversation_flags_{suffix}",
            on(name, quality.conversation_flags, chosen),
            with_sql(
                duck.conversation_ctes(name, classic),
                f"select conversation_id, message_count, first_sent_at, {', '.join(duck.ISSUES)} from c",
            ),
        )

# ------------------------------------------------------- conversation flags

FLAGS = {name: on(name, quality.conversation_flags) for name in VIEW}
NO_DEDUP = on("pairs", quality.conversation_flags, dedup_scope=None)
for issue in duck.ISSUES:
    source = FLAGS["pairs"] if issue == "duplicate" else NO_DEDUP
    add(
        f"conv_{issue}",
        then(source, lambda df, issue=issue: df.select("conversation_id", issue)),
        with_sql(duck.conversation_ctes("pairs"), f"select conversation_id, {issue} from c"),
    )
add(
    "conversation_duplicates_only",
    then(
        on("pairs", quality.conversation_flags, dedup_scope="conversation"),
        lambda df: df.select("conversation_id", "duplicate"),
    ),
    with_sql(
        duck.conversation_ctes("pairs", scope="conversation"), "select conversation_id, duplicate from c"
    ),
)


def _first_occurrence(spark, sf):
    m = VIEW["pairs"](spark, sf)
    features = stored(quality.message_features(m).drop(*quality.SHARES, *quality.ANY), "features")
    wholes = stored(quality.gate_counters(features), "wholes")
    checked = quality.checked_conversations(wholes)
    return dup.first_occurrence(features, wholes, m, checked_ids=checked).drop("sent_at")


add(
    "first_occurrence",
    _first_occurrence,
    with_sql(
        duck.conversation_ctes("pairs"),
        "select conversation_id, kind, message_id, duplicate from ranked",
    ),
)
add(
    "checked_conversations",
    on("doc", lambda m: quality.checked_conversations(quality.gate_counters(quality.message_features(m)))),
    with_sql(
        duck.conversation_ctes("doc"),
        "select conversation_id from g where not (empty or too_short or single_turn)",
    ),
)

# ------------------------------------------------------------------ reports

METRIC_COLUMNS = "total_conversations, total_messages, " + ", ".join(duck.ISSUES) + ", usable"
METRICS = {name: then(query, reports.quality_metrics) for name, query in FLAGS.items()}
SEGMENTS = {name: then(query, reports.stratified_metrics) for name, query in FLAGS.items()}
for name in ("conv", "doc", "pairs"):
    add(
        f"quality_metrics_{name}",
        METRICS[name],
        with_sql(duck.metrics_ctes(name), f"select {METRIC_COLUMNS} from q"),
    )
    add(
        f"stratified_metrics_{name}",
        SEGMENTS[name],
        with_sql(duck.segment_ctes(name), "select * from seg"),
    )
    add(
        f"usable_conversations_{name}",
        then(FLAGS[name], quality.usable_conversations),
        with_sql(
            duck.conversation_ctes(name),
            "select conversation_id, length_category, time_bucket from c where usable",
        ),
    )


def _in_pulls(spark, sf) -> MetricsStore:
    """Two pulls of whole conversations, so that copies lie on both sides; the second is added twice."""
    m = VIEW["pairs"](spark, sf)
    kept = MetricsStore(spark, work_folder(spark, "metrics"))
    half = F.pmod(F.xxhash64("conversation_id"), F.lit(2))
    kept.add(m.filter(half == 0), "first")
    for _ in range(2):
        kept.add(m.filter(F.coalesce(half, F.lit(1)) == 1), "second")
    return kept


add("incremental_metrics", lambda spark, sf: _in_pulls(spark, sf).quality_metrics(), ORACLES["quality_metrics_pairs"])
add("incremental_segments", lambda spark, sf: _in_pulls(spark, sf).stratified_metrics(), ORACLES["stratified_metrics_pairs"])
add("incremental_flags", lambda spark, sf: _in_pulls(spark, sf).conversation_flags(), ORACLES["conversation_flags_pairs"])
UNPIVOT = " union all ".join(f"select '{k}' as issue, {k} as flag from c" for k in duck.ISSUES)
add(
    "issue_flag_counts",
    then(FLAGS["pairs"], reports.issue_flag_counts),
    with_sql(
        duck.conversation_ctes("pairs"),
        f"select issue, flag, count(*) as n from ({UNPIVOT}) group by all",
    ),
)
REPORT = " union all ".join(
    f"""select '{k}' as issue, {k} as count, case when total_conversations = 0 then 0.0 else
        round_even({k} * 100.0::double / total_conversations, 2) end as percentage from q"""
    for k in duck.ISSUES
)
add(
    "issue_report",
    then(METRICS["pairs"], reports.issue_report),
    with_sql(duck.metrics_ctes("pairs"), REPORT),
)
add(
    "top_issues",
    then(METRICS["pairs"], reports.top_issues),
    with_sql(
        duck.metrics_ctes("pairs"),
        f"select * from ({REPORT}) order by percentage desc, issue limit 5",
    ),
)
add(
    "usable_percentage",
    then(METRICS["pairs"], reports.usable_percentage, rounded),
    with_sql(
        duck.metrics_ctes("pairs"),
        f"""select total_conversations, usable, round({duck.reported()}, 6) as usable_pct_reported,
                   round(usable * 100.0::double / total_conversations, 6) as usable_pct_ids from q""",
    ),
)
add(
    "usable_by_time",
    then(FLAGS["pairs"], reports.usable_by_time),
    with_sql(
        duck.conversation_ctes("pairs"),
        "select time_bucket, count(*) as usable_count from c where usable group by 1",
    ),
)
RATE = 0.3


def _projection(spark, sf):
    m = VIEW["pairs"](spark, sf)
    sample = joins.fetch_by_ids(m, sampling.percent_sample(m, RATE))
    return rounded(reports.projection(reports.quality_metrics(quality.conversation_flags(sample)), RATE))


SAMPLED_PAIRS = f"select * from ({duck.VIEWS['pairs']}) where {duck.below_rate(SEED, RATE, 'conversation_id')}"
add(
    "projection",
    _projection,
    with_sql(
        duck.metrics_ctes("pairs", source=SAMPLED_PAIRS),
        f""", e as (select *, cast(trunc(total_conversations * (1.0::double / {RATE}::double)) as bigint) as n,
                          total_messages / cast(total_conversations as double) as per,
                          {duck.reported()} / 100 as share from q)
        select n as estimated_total_conversations,
               cast(trunc(n * per) as bigint) as estimated_total_messages,
               round_even(per, 2) as average_messages_per_conversation,
               cast(trunc(n * share) as bigint) as estimated_usable_conversations,
               n - cast(trunc(n * share) as bigint) as estimated_unusable_conversations,
               {', '.join(f"cast(trunc({k} * (1.0::double / {RATE}::double)) as bigint) as projected_{k}" for k in duck.ISSUES)}
        from e""",
    ),
)
add(
    "run_summary",
    then(METRICS["pairs"], reports.run_summary, rounded),
    with_sql(
        duck.metrics_ctes("pairs"),
        f"""select total_conversations, total_messages, usable as total_usable_conversations,
                   round_even({duck.reported()}, 2) as usable_conversation_percentage,
                   '2023-07-01 to 2025-01-31' as date_range, 'full' as sampling_method,
                   1.0::double as sample_rate from q""",
    ),
)
MATRIX = ", ".join(
    f"""coalesce(max(usable_percentage) filter (where time_bucket = '{q}'), 0.0) as "{q}" """
    for q, _, _ in duck.BUCKETS
)
ALL_LENGTHS = "(select unnest(['one_off', 'short', 'medium', 'long']) as length_category) k"
for name in ("doc", "pairs"):
    add(
        f"usability_matrix_{name}",
        then(SEGMENTS[name], reports.usability_matrix),
        with_sql(
            duck.segment_ctes(name),
            f"select length_category, {MATRIX} from {ALL_LENGTHS} left join seg using (length_category) group by 1",
        ),
    )
add(
    "length_totals",
    then(SEGMENTS["doc"], reports.length_totals),
    with_sql(
        duck.segment_ctes("doc"),
        f"""select length_category, cast(coalesce(sum(total_conversations), 0) as bigint) as total_conversations
            from {ALL_LENGTHS} left join seg using (length_category) group by 1""",
    ),
)
add(
    "usable_by_length",
    then(SEGMENTS["conv"], reports.usable_by_length, rounded),
    with_sql(
        duck.segment_ctes("conv"),
        """, u as (select length_category, cast(sum(total_conversations) as bigint) as total_conversations,
                      cast(sum(usable) as bigint) as usable,
                      cast(sum(trunc(total_conversations * usable_percentage / 100)) as bigint) as usable_reported
               from seg group by 1)
        select *, round(usable * 100.0::double / total_conversations, 6) as usable_pct,
               round(usable_reported * 100.0::double / total_conversations, 6) as usable_pct_reported from u""",
    ),
)
RANK = "list_position(['one_off', 'short', 'medium', 'long'], length_category)"
MIN_SIZE = 10
add(
    "top_segments",
    then(SEGMENTS["pairs"], lambda df: reports.top_segments(df, MIN_SIZE)),
    with_sql(
        duck.segment_ctes("pairs"),
        f"""select length_category, time_bucket, total_conversations, usable_percentage from seg
            where total_conversations >= {MIN_SIZE}
            order by usable_percentage desc, {RANK}, time_bucket limit 10""",
    ),
)
add(
    "recommended_segments",
    then(SEGMENTS["pairs"], lambda df: reports.recommended_segments(df, MIN_SIZE)),
    with_sql(
        duck.segment_ctes("pairs"),
        f"""select count(*) over () as n_segments,
                   cast(sum(total_conversations) over () as bigint) as n_conversations,
                   cast(row_number() over (order by usable_percentage desc, {RANK}, time_bucket) as int) as rank,
                   length_category, time_bucket, total_conversations, usable_percentage
            from seg where total_conversations >= {MIN_SIZE} and usable_percentage >= 70
            qualify rank <= 5""",
    ),
)
add(
    "usable_segment_counts",
    then(QUERIES["usable_conversations_conv"], reports.usable_segment_counts),
    with_sql(
        duck.conversation_ctes("conv"),
        """select length_category, time_bucket, count(*) as usable_count from c where usable group by 1, 2
           union all select 'all', 'all', count(*) from c where usable""",
    ),
)
SUMMARY_SQL = with_sql(
    duck.conversation_ctes("pairs"),
    """select length_category, time_bucket, count(*) as usable_count,
              'length_category=' || length_category || '/time_bucket=' || time_bucket as folder
       from c where usable group by 1, 2""",
)


def _ids_export(spark, sf):
    path = work_folder(spark, "usable-ids")
    sinks.write_usable_ids(QUERIES["usable_conversations"](spark, sf), path)
    return spark.read.json(f"{path}/summary")


add("usable_ids_export", _ids_export, SUMMARY_SQL)

for part, columns in (("ids", "length_category, time_bucket, "), ("by_time", "time_bucket, "), ("all", "")):

    def _ids_back(spark, sf, part=part):
        path = work_folder(spark, "usable-ids")
        sinks.write_usable_ids(QUERIES["usable_conversations"](spark, sf), path)
        return spark.read.text(f"{path}/{part}").withColumnRenamed("value", "conversation_id")

    add(
        f"usable_{part}_read_back",
        _ids_back,
        with_sql(
            duck.conversation_ctes("pairs"),
            f"select {columns}cast(conversation_id as varchar) as conversation_id from c where usable",
        ),
    )


def _json_report(spark, sf):
    path = work_folder(spark, "report")
    sinks.write_json_report(QUERIES["issue_report"](spark, sf), path)
    return spark.read.json(path)


add("json_report", _json_report, ORACLES["issue_report"])


def _verdict_log(spark, sf):
    path = work_folder(spark, "verdicts")
    verdicts = views.verdicts(spark, sf)
    for part in (verdicts.filter("quality <= 5"), verdicts.filter("quality > 5")):
        sinks.append_verdicts(part, path)
    return spark.read.schema(verdicts.schema).json(path)


add("verdict_log_append", _verdict_log, duck.VERDICTS)

# --------------------------------------------------------- tokens and costs

TOKENS = {name: on(name, costs.token_rows) for name in ("conv", "doc")}
for name in ("conv", "doc"):
    stats = then(TOKENS[name], costs.token_stats)
    breakdown = then(stats, costs.cost_breakdown)
    add(
        f"estimate_tokens_{name}",
        TOKENS[name],
        with_sql(
            duck.token_ctes(name),
            "select * replace (cast(time_quarter as timestamp) as time_quarter) from tok",
        ),
    )
    add(
        f"token_stats_{name}",
        then(stats, rounded),
        with_sql(duck.token_ctes(name), "select * from tstats"),
    )
    add(
        f"cost_breakdown_{name}",
        then(breakdown, rounded),
        with_sql(
            duck.token_ctes(name),
            """select * replace (round(tokens_millions, 6) as tokens_millions,
                   round(estimated_cost_usd, 6) as estimated_cost_usd,
                   round(avg_tokens_per_conversation, 6) as avg_tokens_per_conversation) from price""",
        ),
    )
    add(
        f"cost_summary_{name}",
        then(breakdown, costs.cost_summary, rounded),
        with_sql(
            duck.token_ctes(name),
            """, z as (select cast(sum(total_conversations) as bigint) as total_conversations,
                          cast(sum(total_tokens) as bigint) as total_tokens from price),
            y as (select *, total_tokens * 0.9::double / 1e6 * (0.55::double * 1.2::double) as ci,
                         total_tokens * 0.1::double / 1e6 * (2.19::double * 1.2::double) as co from z)
            select total_conversations, total_tokens, round(total_tokens / 1e6, 6) as total_tokens_millions,
                   round(total_tokens * 0.9::double / 1e6, 6) as input_tokens_millions,
                   round(total_tokens * 0.1::double / 1e6, 6) as output_tokens_millions,
                   round(ci, 6) as input_cost_usd, round(co, 6) as output_cost_usd,
                   round(ci + co, 6) as total_cost_usd,
                   round((ci + co) / total_conversations, 6) as avg_cost_per_conversation,
                   round(total_tokens / cast(total_conversations as double), 6) as avg_tokens_per_conversation
            from y""",
        ),
    )


def _words_and_marks(spark, sf):
    t = transcripts.transcript_plain(VIEW["conv"](spark, sf))
    count = F.sum(tk.count_words_and_marks(F.col("combined_text")))
    return t.groupBy("conversation_id").agg(count.alias("token_count"))


add(
    "count_words_and_marks",
    _words_and_marks,
    f"""select conversation_id,
               cast(len(regexp_extract_all(combined_text, '[{duck.WORD}]+|[^{duck.WORD}{duck.UNICODE_SPACE}]')) as bigint)
               as token_count from ({ORACLES['transcript_plain_conv']})""",
)


def _count_tokens(spark, sf):
    def split_on_space(texts):
        return [[w for w in t.split(" ") if w] for t in texts]

    rows = costs.token_rows(VIEW["doc"](spark, sf), tk.tokenizer_counts(split_on_space))
    return rows.select("conversation_id", "length_category", "token_count")


add(
    "count_tokens",
    _count_tokens,
    with_sql(
        duck.token_ctes("doc"),
        f""", j as (select conversation_id, string_agg(coalesce(text, ''), ' ' order by sent_at, message_id) as t
                   from m where {duck.in_range()} group by 1)
        select conversation_id, length_category, cast(len(regexp_extract_all(t, '[^ ]+')) as bigint) as token_count
        from tok join j using (conversation_id)""",
    ),
)


def _token_csv(spark, sf):
    path = work_folder(spark, "tokens")
    return rounded(token_cost_run(VIEW["doc"](spark, sf), path)["cost_summary"])


add("token_cost_csv", _token_csv, ORACLES["cost_summary_doc"])


def _token_csv_back(spark, sf):
    path = work_folder(spark, "tokens")
    token_cost_run(VIEW["doc"](spark, sf), path)
    kinds = costs.token_rows(VIEW["doc"](spark, sf)).schema
    return spark.read.option("header", True).schema(kinds).csv(f"{path}/tokens")


add("token_rows_read_back", _token_csv_back, ORACLES["estimate_tokens_doc"])

# -------------------------------------------------------------------- judge


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


add(
    "prompt_column",
    then(
        on("conv", transcripts.transcript_authored),
        lambda t: t.select("conversation_id", judge.prompt(F.col("full_conversation")).alias("prompt")),
    ),
    with_sql(
        _transcripts_sql("conv"),
        f"""select conversation_id, {_quote(duck.PROMPT_HEAD)} || full_conversation ||
                   {_quote(duck.PROMPT_TAIL)} as prompt from t""",
    ),
)


def _fenced_verdicts(spark, sf):
    """Verdicts as answers: plain, fenced, fenced with a language, cut off, not an object."""
    v = views.verdicts(spark, sf)
    body = F.to_json(F.struct(*[c for c in v.columns if c != "conversation_id"]))
    quality = F.col("quality")
    answer = (
        F.when(quality <= 3, body)
        .when(quality <= 5, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(quality <= 7, F.concat(F.lit("\n ```"), body, F.lit("``` ")))
        .when(quality <= 9, F.substr(body, F.lit(1), F.length(body) - 1))
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    return v.select("conversation_id", answer.alias("response"), F.lit(None).cast("string").alias("error"))


add(
    "clean_verdict",
    lambda spark, sf: judge.split_verdicts(_fenced_verdicts(spark, sf))[0],
    f"""select conversation_id, quality, null::varchar as topic, null::varchar as summary,
               null::varchar as classification_reasoning, contains_pii, contains_sensitive_content, is_safe,
               response_accuracy, null::boolean as ai_assistant_is_wrong, language
        from ({duck.VERDICTS}) where quality <= 7""",
)
add(
    "verdict_errors",
    lambda spark, sf: judge.split_verdicts(_fenced_verdicts(spark, sf))[1].select("conversation_id", "error"),
    f"select conversation_id, 'not a JSON object' as error from ({duck.VERDICTS}) where quality > 7",
)


def _stub_scorer():
    """Deterministic stand-in for a judge: answers by length, fails on every seventh length."""
    head, tail = len(judge.PROMPT_HEAD), len(judge.PROMPT_TAIL)

    def score(question: str) -> str:
        import json

        n = len(question) - head - tail
        if n % 7 == 0:
            raise ValueError("the judge did not answer")
        verdict = {"quality": 1 + n % 10, "is_safe": n % 3 != 0, "language": "xx"}
        return "```json\n" + json.dumps(verdict) + "\n```"

    return score


def _readable(spark, sf):
    """Whole transcripts of the conversations that pass the prefilter."""
    m = VIEW["pairs"](spark, sf)
    return transcripts.whole(transcripts.parts_of(m, f.prefilter(transcripts.authored_counts(m))))


def _judge_scores(spark, sf):
    readable = _readable(spark, sf)
    verdicts, _ = judge.split_verdicts(judge.judge_responses(readable, _stub_scorer()))
    return verdicts.select("conversation_id", "quality", "is_safe", "language")


READABLE = f"(select * from a where n >= 50 and alpha >= 0.7)"
add(
    "judge_scores",
    _judge_scores,
    with_sql(
        _transcripts_sql("pairs"),
        f"""select conversation_id, cast(1 + n % 10 as int) as quality, n % 3 <> 0 as is_safe, 'xx' as language
            from {READABLE} where n % 7 <> 0""",
    ),
)


def _judge_resumed(spark, sf):
    """A run over a third of the conversations, and one over all that asks only what is open."""
    readable, path = stored(_readable(spark, sf), "readable"), work_folder(spark, "judge")
    JudgeRun(path, 3).responses(readable.filter(F.pmod(F.xxhash64("conversation_id"), F.lit(3)) == 0), _stub_scorer())
    verdicts, _ = judge.split_verdicts(JudgeRun(path, 3).responses(readable, _stub_scorer()))
    return verdicts.select("conversation_id", "quality", "is_safe", "language")


add("judge_resumed", _judge_resumed, ORACLES["judge_scores"])


def _judge_errors(spark, sf):
    """Errors of the whole run, each with the number of verdicts and of conversations asked."""
    readable = _readable(spark, sf)
    answers = judge.judge_responses(readable, _stub_scorer())
    path = work_folder(spark, "answers")
    answers.write.parquet(path)
    verdicts, errors = judge.split_verdicts(spark.read.parquet(path))
    return (
        errors.select("error", F.lit(1).alias("wrong"))
        .unionByName(verdicts.select(F.lit(None).cast("string").alias("error"), F.lit(0).alias("wrong")))
        .agg(F.max("error").alias("error"), F.sum("wrong").alias("errors"), F.count("*").alias("asked"))
        .withColumn("verdicts", F.col("asked") - F.col("errors"))
    )


add(
    "judge_errors",
    _judge_errors,
    with_sql(
        _transcripts_sql("pairs"),
        f"""select 'the judge did not answer' as error, cast(count(*) filter (where n % 7 = 0) as bigint) as errors,
                   count(*) as asked, cast(count(*) filter (where n % 7 <> 0) as bigint) as verdicts from {READABLE}""",
    ),
)


def _filter_and_judge(spark, sf):
    path = work_folder(spark, "judge")
    return rounded(filter_and_judge(VIEW["pairs"](spark, sf), _stub_scorer(), path, n=200)["judge_summary"])


add(
    "filter_and_judge",
    _filter_and_judge,
    f"""with ids as (select conversation_id from (select distinct conversation_id from ({duck.VIEWS['pairs']}))
             order by {duck.order_hash(SEED, 'conversation_id')}, conversation_id limit 200),
        {_transcripts_sql('pairs')},
        v as (select 1 + n % 10 as quality, n % 3 <> 0 as is_safe
              from {READABLE} semi join ids using (conversation_id) where n % 7 <> 0)
        select count(*) as total_conversations, round(avg(quality), 6) as quality_mean,
               round(median(quality), 6) as quality_median, round(stddev_samp(quality), 6) as quality_std,
               count(*) filter (where is_safe) as safe_conversations, 0::bigint as contains_pii,
               0::bigint as contains_sensitive from v""",
)
add(
    "judge_summary",
    lambda spark, sf: rounded(reports.judge_summary(views.verdicts(spark, sf))),
    f"""select count(*) as total_conversations, round(avg(quality), 6) as quality_mean,
               round(median(quality), 6) as quality_median, round(stddev_samp(quality), 6) as quality_std,
               count(*) filter (where is_safe) as safe_conversations,
               count(*) filter (where contains_pii) as contains_pii,
               count(*) filter (where contains_sensitive_content) as contains_sensitive
        from ({duck.VERDICTS})""",
)
add(
    "judge_distribution",
    lambda spark, sf: reports.judge_distribution(views.verdicts(spark, sf)),
    f"""select 'language' as field, language as value, count(*) as n from ({duck.VERDICTS}) where language is not null group by 2
        union all select 'response_accuracy', response_accuracy, count(*) from ({duck.VERDICTS}) group by 2""",
)

# --------------------------------------------------------------- whole runs


def _stratified_run(spark, sf):
    run = stratified_run(VIEW["pairs"](spark, sf), work_folder(spark, "run"), target=840)
    return reports.stratified_metrics(run.flags)


add(
    "stratified_run",
    _stratified_run,
    with_sql(
        duck.segment_ctes(
            "pairs",
            source=f"""select * from ({duck.VIEWS['pairs']}) where conversation_id in
                       (select conversation_id from ({_stratified_sql('pairs', 840)}))""",
        ),
        "select * from seg",
    ),
)


def _stored_run(spark, sf):
    kept = _whole_store(spark, sf)
    run = stored_run(kept.metadata(), kept.messages(), work_folder(spark, "run"))
    return reports.stratified_metrics(run.flags)


add(
    "stored_run",
    _stored_run,
    with_sql(
        duck.segment_ctes(
            "conv",
            source=f"""with {duck.rollup_ctes('conv')} select * from m
                       where {duck.in_range()} and conversation_id in (select conversation_id from two)""",
        ),
        "select * from seg",
    ),
)


def _classic_run(spark, sf):
    run = classic_run(VIEW["conv"](spark, sf), work_folder(spark, "run"), two_sided=True)
    return reports.quality_metrics(run.flags)


add(
    "classic_run",
    _classic_run,
    with_sql(
        duck.metrics_ctes(
            "conv",
            classic=True,
            source=f"""with {duck.rollup_ctes('conv')} select * from m
                       where {duck.in_range()} and conversation_id in (select conversation_id from two)""",
        ),
        f"select {METRIC_COLUMNS} from q",
    ),
)

# ---------------------------------------------------------------- streaming


def _document_stream(spark, sf, folder=None, **options):
    """The documents table as a file stream, out of ``folder`` if it was copied there."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    path = folder or f"{sf}/documents*.parquet"
    return views.doc_messages_from(streams.read_messages(spark, path, schema, **options))


def _six_files(spark, sf) -> str:
    path = work_folder(spark, "stream-source")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(6, "doc_id").write.parquet(path)
    return path


def _stream_pull(spark, sf):
    path = work_folder(spark, "stream")
    for _ in range(2):  # the second start finds nothing new
        streams.stream_pull(_document_stream(spark, sf), f"{path}/table", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/table")


add("stream_pull", _stream_pull, ORACLES["date_range_filter_doc"])


def _stream_flags(spark, sf):
    """Six files, one per batch, and a restart that finds nothing new."""
    path, source = work_folder(spark, "stream"), _six_files(spark, sf)
    for _ in range(2):
        stream = _document_stream(spark, sf, source, maxFilesPerTrigger=1)
        streams.stream_message_flags(stream, f"{path}/table", f"{path}/state").awaitTermination()
    return streams.read_daily_flag_counts(spark, f"{path}/table")


DAILY = f"""select cast(date_trunc('day', sent_at) as timestamp) as day, count(*) as n_messages,
       {', '.join(f"count(*) filter (where {k}) as n_{k}" for k in duck.MESSAGE_FLAGS)}
       from f group by 1"""
add(
    "stream_message_flags",
    _stream_flags,
    with_sql(duck.flag_ctes("doc"), DAILY),
)
add(
    "daily_message_flags",
    on("doc", streams.daily_flag_counts),
    with_sql(duck.flag_ctes("doc"), DAILY),
)


DEDUP_DAYS, SPAN = 30, 120


def _stream_dedup(spark, sf):
    """What the watermark promises, over spans of days that arrive one after the other.

    Every text is kept; it may come again only after the watermark's time.  One pass deals the messages
    over folders, and each folder is a batch; messages without a time come first, as the oldest.
    """
    path, source = work_folder(spark, "stream"), work_folder(spark, "stream-source")
    m = VIEW["doc"](spark, sf)
    m = m.withColumn("sent_at", F.coalesce("sent_at", F.lit(views.EPOCH).cast("timestamp")))
    last = 640 // SPAN + 1  # the view's times lie within 640 days and the hours of a day
    span = F.least(F.floor(F.datediff("sent_at", F.lit(views.EPOCH)) / SPAN), F.lit(last)).cast("int")
    m.withColumn("span", span).write.partitionBy("span").parquet(f"{path}/spans")
    spans = spark.read.schema(StructType([*m.schema.fields, StructField("span", IntegerType())])).parquet(f"{path}/spans")
    for k in range(last + 1):
        spans.filter(F.col("span") == k).drop("span").write.mode("append").parquet(source)
        stream = streams.read_messages(spark, source, m.schema)
        kept = streams.stream_dedup(stream, f"{DEDUP_DAYS} days").select("text", "sent_at")
        writer = kept.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        writer.option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").start().awaitTermination()
    texts = spark.read.parquet(f"{path}/table").withColumn("norm", tx.normalise(F.col("text")))
    seconds = F.col("sent_at").cast("long")
    gap = seconds - F.lag(seconds).over(W.partitionBy("norm").orderBy("sent_at"))
    per_text = texts.withColumn("gap", gap).groupBy("norm").agg(F.min("gap").alias("gap"))
    return per_text.agg(
        F.count("*").alias("n_texts"), F.count_if(F.col("gap") <= DEDUP_DAYS * 86400).alias("too_early")
    )


add(
    "stream_dedup",
    _stream_dedup,
    f"select count(distinct lower({duck.strip('text')})) as n_texts, 0::bigint as too_early from documents",
)


def _stream_first_texts(spark, sf):
    """Six files, one per batch, snapshots in between, and a restart that finds nothing new."""
    path, source = work_folder(spark, "stream"), _six_files(spark, sf)
    for _ in range(2):
        stream = _document_stream(spark, sf, source, maxFilesPerTrigger=1)
        streams.stream_first_texts(stream, f"{path}/table", f"{path}/state", compact_every=2).awaitTermination()
    kept = streams.read_first_texts(spark, f"{path}/table", stream.schema)
    return kept.select(tx.normalise(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


add(
    "stream_first_texts",
    _stream_first_texts,
    f"select distinct lower({duck.strip("coalesce(text, '')")}) as text from ({duck.VIEWS['doc']})",
)


def _plain_names(table: dict) -> dict:
    """An operator checked on several views keeps its plain name for one of them."""
    plain = {}
    for suffix in ("pairs", "doc", "conv"):
        for name in QUERIES:
            base = name.removesuffix(f"_{suffix}")
            if base != name and base not in plain.values():
                plain[name] = base
    return {plain.get(name, name): value for name, value in table.items()}


QUERIES, ORACLES = _plain_names(QUERIES), _plain_names(ORACLES)
