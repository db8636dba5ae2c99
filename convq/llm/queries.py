"""The registered queries of this package, next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from convq.llm import (
    ann,
    chat,
    decontaminate,
    merkle,
    mixing,
    pii,
    simhash,
    spelling,
    substring,
    suffix,
    toxicity,
    urls,
    warc,
)
from convq.sources.workspace import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 1: mixing


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


MIX_SQL = """
with recursive d as (
    select doc_id, source, coalesce('=' || source, '') as k,
        md5(coalesce(cast(doc_id as varchar), '') || ':42') as h
    from documents),
r as (select *, row_number() over (partition by k order by h, doc_id) - 1 as i from d),
sizes as (select k, count(*) as n, cast(floor(sqrt(cast(count(*) as double)) * 1000) as bigint) as w from d group by k),
parts as (
    select *, 1000 - count(*) over () as spare, sum(w) over () as total,
        (w * (1000 - count(*) over ())) // sum(w) over () as base
    from sizes),
shares as (
    select k, n, 1 + base + case when row_number() over (order by w * spare - base * total desc, k)
        <= spare - sum(base) over () then 1 else 0 end as q
    from parts),
names as (select list(k order by k) as ks, list(q order by k) as qs, count(*) as m from shares having count(*) > 0),
steps(t, done, pick) as (
    select 0, list_transform(qs, lambda q: 0), 0 from names
    union all
    select t + 1, list_transform(range(m), lambda i: done[i + 1] + case when i + 1 = p then 1 else 0 end), p
    from (
        select t, done, qs, m, list_min(list_filter(list_transform(range(m), lambda i:
            case when done[i + 1] < qs[i + 1] and done[i + 1] * 1000 // qs[i + 1] <= t
                then ((done[i + 1] + 1) * 1000 + qs[i + 1] - 1) // qs[i + 1] * 10000 + i + 1 end),
            lambda x: x is not null)) % 10000 as p
        from steps, names where t < 1000)),
slots as (
    select ks[pick] as k, t - 1 as slot, row_number() over (partition by pick order by t) - 1 as turn
    from steps, names where t > 0),
gap as (
    select min(n // 16 // q * 1000 + slot) as gap from shares join slots on slots.k = shares.k and turn = n // 16 % q)
select doc_id, source, cast(i // 16 as bigint) as mix_block, cast(i // 16 // q * 1000 + slot as bigint) as mix_slot,
    cast(i % 16 as integer) as mix_place, i // 16 // q * 1000 + slot < gap as mix_level
from r join shares on shares.k = r.k join slots on slots.k = r.k and turn = i // 16 % q, gap
"""
add("op1_mix_sources", op1_mix_sources, MIX_SQL)


# ---- 2: benchmark decontamination


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
DECONTAMINATE_SQL = f"""
with b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
cut as (
    select item, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') as win, least(len(w), 13) as l
    from (select item, w, unnest(range(greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
places as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from d),
windows as (
    select r, i, l, string_agg(word, ' ') over f as win, count(*) over f as n
    from places, (select distinct l from cut) as lengths
    window f as (partition by r, l order by i rows between current row and l - 1 following)),
found as (select r, i, windows.l, item from windows join cut on cut.l = windows.l and cut.win = windows.win where n = windows.l),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + l)) as p from found) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as ids
    from (select distinct r, item from found where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
    cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from d left join hit on hit.r = d.r left join items on items.r = d.r
"""
add("op2_decontaminate", op2_decontaminate, DECONTAMINATE_SQL)


# ---- 3: suffix-array dedup


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(read(spark, sf_dir, "documents"), with_kept=False)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )


add("op3_suffix_dedup", op3_suffix_dedup)


# ---- 4: chat formatting


def op4_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


add("op4_format_chats", op4_format_chats)


# ---- 5: WARC


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    captured = warc.assemble(warc.read_records(spark, path))
    return captured.select(
        "page_id",
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        F.col("response.refers_to").cast("bigint").alias("refers_to"),
    )


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
s as (select html, max(page_id) as original, count(*) as c from p where n >= 1000 group by html)
select p.page_id, cast(n as bigint) as payload_bytes, sha1(p.html) as payload_digest,
    case when c > 1 and original is not null and p.page_id is distinct from original then 'revisit' else 'response' end
        as record_type,
    case when c > 1 and p.page_id is distinct from original then original end as refers_to
from p left join s on s.html = p.html
"""
add("op5_warc_transactions", op5_warc_transactions, WARC_SQL)


# ---- 6: approximate nearest neighbours


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


add("op6_nearest", op6_nearest)


# ---- 7: personal data


def op7_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.with_spans(docs.select("doc_id", "text"), pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


add("op7_find_pii", op7_find_pii)


# ---- 8: SimHash near-duplicates


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


add("op8_simhash", op8_simhash)


# ---- 9: substring dedup


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(read(spark, sf_dir, "documents"), with_kept=False)
    return found.select(F.col("doc").alias("doc_id"), F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


add("op9_substring_dedup", op9_substring_dedup)


# ---- 10: toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.with_scores(docs.select("doc_id", "text"), toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


add("op10_toxicity", op10_toxicity)


# ---- 11: Merkle manifest


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text``, four bits at a step."""
    table = []
    for i in range(16):
        value = i
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = f"hex(encode({text}))"
    steps = (
        f"list_transform(range(length({digits})), lambda i: "
        f"strpos('0123456789ABCDEF', substr({digits}, i + 2 - 2 * (i % 2), 1)) - 1)"
    )
    return (
        f"xor(list_reduce(list_prepend(4294967295, {steps}), "
        f"lambda c, x: xor({table}[(xor(c, x) & 15) + 1], c >> 4)), 4294967295)"
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    field = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar), '-')"
    return f"sha256({' || '.join(field.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels_sql(name: str, base: str) -> str:
    return f"""
{name}(l, tree, i, h) as (
    {base}
    union all
    select l + 1, tree, i // 16, sha256(string_agg(h, '' order by i))
    from (select *, count(*) over (partition by tree) as c from {name}) where c > 1 group by l, tree, i // 16),
{name}_top as (select tree, max(l) as top, arg_max(h, l) as root from {name} group by tree),
{name}_runs as (
    select l, tree, i // 16 as run, list(h order by i) as hs from {name} join {name}_top using (tree) where l < top
    group by l, tree, i // 16)"""


def _steps_sql(level: str) -> str:
    place = f"({level}.i >> (4 * l)) % 16"
    return f"array_to_string(hs[1:{place}], '') || '|' || array_to_string(hs[{place} + 2:], '')"


MERKLE_SQL = f"""
with recursive d as (
    select doc_id, coalesce('=' || source, '') as tree, {_leaf_sql("text")} as leaf,
        case when {crc32_sql("cast(doc_id as varchar)")} % 5 = 0 then {_leaf_sql(_LOWER.format("text"))}
            else {_leaf_sql("text")} end as other
    from documents),
leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, row_number() over () as r from d),
{_levels_sql("below", "select 0, tree, i, leaf from leaves")},
sources as (select *, row_number() over (order by tree) - 1 as i from below_top),
{_levels_sql("above", "select 0, '', i, root from sources")},
steps as (
    select r, l as k, {_steps_sql("leaves")} as step
    from leaves join below_runs b on b.tree = leaves.tree and run = leaves.i >> (4 * (l + 1))
    union all
    select r, 1000 + l, {_steps_sql("sources")}
    from leaves join sources on sources.tree = leaves.tree join above_runs on run = sources.i >> (4 * (l + 1))),
proofs as (select r, list(step order by k) as steps from steps group by r)
select doc_id, leaf, sources.root as subroot, above_top.root as root,
    sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) as proof_sha256,
    list_reduce(list_prepend(other, coalesce(steps, [])),
        lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) as folded_root,
    folded_root = above_top.root as verified
from leaves join sources on sources.tree = leaves.tree cross join above_top left join proofs on proofs.r = leaves.r
"""
add("op11_merkle_manifest", op11_merkle_manifest, MERKLE_SQL)


# ---- 12: URL filter

# fixed values: the rules of the contract
RULES = (
    ("com/", urls.ALLOW),
    ("example.com/en/", urls.BLOCK),
    ("www.example.com/en/", urls.ALLOW),
    ("net/es/", urls.BLOCK),
    ("net/fr/", urls.BLOCK),
)


def op12_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, RULES, urls.fit(urls.labelled_by_rules(pages, RULES)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


add("op12_filter_urls", op12_filter_urls)


# ---- 13: spelling variants


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read(spark, sf_dir, "documents").select("doc_id", "text"), damage=199)
    return spelling.variants(words)


_HASH = crc32_sql("coalesce(cast(doc_id as varchar), '') || ':' || run")
SPELLING_SQL = f"""
with recursive runs as (
    select doc_id, {_LOWER.format("run")} as run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as run from documents)
    group by all),
hashed as (select run, n, {_HASH} as h from runs),
counted as (
    select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word,
        sum(n) as n
    from hashed group by 1),
words as (select word, cast(n as bigint) as n from counted where length(word) >= 6 and n >= 5),
cut as (
    select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
    from (select word, n, unnest(range(length(word))) as i from words)),
near as (
    select a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union
    select cut.word, words.word, words.n from cut join words on words.word = cut.rest
    union
    select words.word, cut.word, cut.n from cut join words on words.word = cut.rest),
best as (
    select word, count(*) as n_near, max(near_n) as top, arg_min(near, (-near_n, near)) as near from near group by word),
forms as (
    select words.word, words.n, coalesce(n_near, 0) as n_near, case when top >= 5 * words.n then near end as form,
        case when top >= 5 * words.n then top end as form_n
    from words left join best on best.word = words.word),
chain as (
    select word, word as root, form as onward from forms
    union all
    select chain.word, forms.word, forms.form from chain join forms on forms.word = chain.onward)
select forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
from forms join chain on chain.word = forms.word and chain.onward is null
"""
add("op13_spelling_variants", op13_spelling_variants, SPELLING_SQL)
