"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bitcodes, decontaminate, htmltext, labelled, licenses, negatives, pieces, quality, repeats, simhash, spelling, toxicity, warc, winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), labelled.id_remainder("doc_id", 5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@_query("op3_winnowing")
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(_table(spark, sf_dir, "documents"))


_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_PLACES = " union all ".join(
    f"select rid, i, '{label}' as label from spot where "
    + " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    for phrase, label in licenses.PHRASES.items()
)
_NOTICES = ", ".join(
    "(" + ", ".join([f"'{label.partition('#')[0]}'", *(f"list_filter(string_split('{w}', ' '), lambda x: x <> '')" for w in words)]) + ")"
    for label, words in ((n, (t, licenses.TELLING.get(n, ""), licenses.FOREIGN.get(n, ""))) for n, t in licenses.NOTICES.items())
)
_LONGEST = max(len(t.split()) for t in licenses.NOTICES.values())


@_query(
    "op5_licenses",
    f"""
with doc as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
worded as (select rid, doc_id, {_WORDS.format(_FOLDED.format("t"))} as w from doc),
spot as (select rid, w, unnest(range(1, len(w) + 1)) as i from worded),
place as ({_PLACES}),
base as (select rid, count(*) as n, min(i) - 1 as a, max(i) - 1 as z, list(distinct label) as labels from place group by rid),
notice as (select label, list_distinct(words) as words, telling, foreign_ from (values {_NOTICES}) as t(label, words, telling, foreign_)),
block as (select rid, unnest(string_split(regexp_replace(t, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))) as b from doc),
sentence as (
    select rid, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(57345), 'g'),
        '\\n[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(57345), 'g'), chr(57345))) as b from doc),
cut as (select rid, {_WORDS.format(_FOLDED.format("b"))} as w from sentence where contains(b, chr(10))),
bag as (
    select rid, {_WORDS.format(_FOLDED.format("b"))} as w from block
    union all select rid, w[k * {_LONGEST} + 1:(k + 2) * {_LONGEST}] from (select rid, w, unnest(range(0, (len(w) + {_LONGEST} - 1) // {_LONGEST})) as k from cut)),
pair as (
    select rid, label, len(list_intersect(words, w)) as common, len(words) as m from bag, notice
    where list_has_all(w, telling) and not list_has_any(w, foreign_)),
hit as (select rid, list(distinct label) as labels, max(common / m) as share from pair
    where common >= ceil({licenses.CONTAINMENT} * m - 1e-9) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, z::bigint as last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ',') as labels,
    case when n > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from worded left join base b using (rid) left join hit h using (rid)
""",
)
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


_OP7_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


@_query(
    "op7_decontaminate",
    f"""
with doc as (select row_number() over () as rid, doc_id, {_OP7_WORDS} as w from documents),
item as (select item_id, {_OP7_WORDS} as w from benchmark),
cut as (select item_id, least(13, len(w)) as size, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
    from item where len(w) > 0),
wanted as (select distinct size, array_to_string(w[i:i + size - 1], ' ') as words, item_id from cut),
sizes as (select distinct size from wanted),
seen as (select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as words
    from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, sizes where len(w) >= size)),
found as (select s.rid, s.i, s.size, t.item_id from seen s join wanted t using (size, words)),
hits as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + size)) as k from found) group by rid),
named as (select rid, count(distinct item_id) as n_items,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hits using (rid) left join named using (rid)
""",
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    )
    return decontaminate.report(scanned)


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), labelled.id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@_query("op4_repeats")
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


@_query(
    "op10_warc",
    """
with page as (select page_id, coalesce(html, '') as p from pages),
sized as (select page_id, strlen(p)::bigint as size, sha256(p) as digest from page),
least as (select digest, min(page_id) as first from sized where size >= 100 group by digest)
select page_id, size as payload_bytes, digest as payload_digest,
    case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
    case when first is distinct from page_id then first end as refers_to
from sized left join least using (digest)
""",
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query("op8_htmltext")
def op8_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"), htmltext.train(htmltext.labelled_pages()))


# CRC-32 over the bytes of a text: a table of 256 remainders made by its rule, then one step for each byte.
_CRC = """
remainder as (
    with recursive step(b, k, c) as (
        select range, 0, range::bigint from range(256)
        union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8)
    select list(c order by b) as list from step where k = 8)"""


@_query(
    "op11_spelling",
    f"""
with recursive {_CRC.strip()},
run as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\u00C0-\u00FF]+')) as run
        from documents where text is not null)
    where length(run) >= 6 group by all),
bytes as (
    select doc_id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from run),
summed as (
    select doc_id, run, n, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint)),
        lambda c, b: xor(c >> 8, list[(xor(c, b) & 255) + 1])), 4294967295) as h
    from bytes, remainder),
word as (
    select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n
    from summed),
vocabulary as (select word, sum(n)::bigint as n from word where length(word) >= 6 group by word having sum(n) >= 5),
cut as (
    select word, n, i, left(word, i) || substr(word, i + 2) as rest
    from (select word, n, unnest(range(0, length(word))) as i from vocabulary)),
near as (
    select distinct a.word, b.word as near, b.n as near_n from cut a join cut b using (i, rest) where a.word <> b.word
    union select c.word, v.word, v.n from cut c join vocabulary v on c.rest = v.word
    union select v.word, c.word, c.n from cut c join vocabulary v on c.rest = v.word),
best as (
    select word, n_near, case when b.near_n >= 5 * n then b.near end as form, case when b.near_n >= 5 * n then b.near_n end as form_n
    from (select v.word, any_value(n) as n, count(*) as n_near, list({{'near_n': near_n, 'near': near}} order by near_n desc, near)[1] as b
        from vocabulary v join near using (word) group by v.word)),
path(word, here, hops) as (
    select word, form, 1 from best where form is not null
    union all select p.word, b.form, hops + 1 from path p join best b on p.here = b.word where b.form is not null),
root as (select word, arg_max(here, hops) as root from path group by word)
select word, form, coalesce(root, word) as root, n, coalesce(n_near, 0)::bigint as n_near, form_n
from vocabulary left join best using (word) left join root using (word)
""",
)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


@_query("op12_neighbours")
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitcodes.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@_query(
    "op13_negatives",
    """
with whole as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
rows as (
    select id, label, v from whole qualify row_number() over (partition by id order by label, v) = 1),
scored as (
    select a.id as anchor_id, b.id, a.label = b.label as same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from rows a join rows b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 100 = 0),
positive as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
    id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
""",
)
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(
        _table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    )
