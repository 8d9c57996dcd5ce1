"""Thin queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.llm.common import table

#: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vesselwatch.llm.pieces import round_trip

    both = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.embeddings import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


#: Demonstration key; a deployment passes its own secret.
PII_KEY = "demonstration-key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.urls import judge_urls

    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.quality import THRESHOLD, is_held_out, score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vesselwatch.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.archives import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).drop("target_uri", "date")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vesselwatch.llm.counting import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vesselwatch.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_embedding": op2_embedding,
    "op3_topk": op3_topk,
    "op4_pii": op4_pii,
    "op5_urls": op5_urls,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_html": op8_html,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_token_counts": op11_token_counts,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


def _level(name: str, members: str, key: str, up: str, prior: str) -> str:
    """A level of the reputation: prior means joined, the strength estimated, posterior means and pseudo-counts; what has no labels keeps its prior's mean."""
    return f"""{name}_j as (select m.*, q.p, q.free from {members} m join {prior} q using ({up})),
{name}_s as (select greatest(1e0, least(1000e0, case when rho > 0 then (1-rho)/rho else 1000e0 end)) as s from (select case when sum(n*p*(1-p)) > sum(p*(1-p))
  then (sum(n*power(bad/n - p, 2)) - sum(p*(1-p))) / (sum(n*p*(1-p)) - sum(p*(1-p))) end as rho from {name}_j where n > 0)),
{name} as (select {key}, (bad + s*p)/(n + s) as p, case when n > 0 then n + s else 1/(1 - free*s/(s+1)) - 1 end as k, case when n > 0 then 1e0 else free*s/(s+1) end as free from {name}_j, {name}_s)"""


def _urls_sql() -> str:
    from vesselwatch.llm.urls import SECOND_LEVEL

    last = lambda c, n: f"array_to_string(list_slice(string_split({c}, '.'), -{n}, -1), '.')"
    second = ", ".join(f"'{label}.{country}'" for country, labels in SECOND_LEVEL.items() for label in labels.split())
    return f"""with rules(verdict, rhost, rpath) as (values {_RULES_SQL}),
u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
w as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null then 0 end) as bad from labels where doc_id is not null group by doc_id),
o as (select host, 1e0 as n, bad::double as bad from (select distinct page_id, host from u where host <> '') join w using (page_id) where bad is not null
  union all select distinct host, 0e0, 0e0 from u where host <> ''),
g as (select host, sum(n) as n, sum(bad) as bad, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]$', '') as name from o group by host),
h as (select host, n, bad, case when regexp_matches(name, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\\[.*\\])$') then name when {last('name', 2)} in ({second}) then {last('name', 3)} else {last('name', 2)} end as domain from g),
d as (select domain, {last('domain', 1)} as suffix, sum(n) as n, sum(bad) as bad from h group by all), f as (select suffix, sum(n) as n, sum(bad) as bad, 0 as root from d group by suffix),
r as (select 0 as root, (sum(bad)+1)/(sum(n)+2) as p, 1e0 as free from f having sum(n) > 0),
{_level('pf', 'f', 'suffix', 'root', 'r')}, {_level('pd', 'd', 'domain', 'suffix', 'pf')}, {_level('ph', 'h', 'host', 'domain', 'pd')},
m as (select u.*, rule, verdict from u left join lateral (select rhost || rpath as rule, verdict from rules where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)
  order by length(rhost || rpath) desc, length(rhost) desc limit 1) on true)
select page_id, m.host, path, rule, coalesce(verdict, case when p - 1.645e0*sqrt(p*(1-p)/(k+1)) > 0.5e0 then 'block' else 'allow' end) as verdict from m left join ph on ph.host = m.host"""


_URLS_SQL = _urls_sql()

_TOPK_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""

_WARC_SQL = """with p as (select page_id, coalesce(html, '') as h from pages), f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to from p left join f using (h)"""

_NEAR_SQL = r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) < 2 then list_transform(ws, lambda x: [x]) else list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]]) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(node, reach) as (select doc_id, doc_id from w union select r.node, e.b from r join e on e.a = r.reach)
select node as doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(reach) as component_id, node = min(reach) as kept from r left join n on n.doc_id = node group by node"""

def _crc32(text: str) -> str:
    """The checksum of a text of code points below 256, bit by bit."""
    code = f"list_transform(string_split({text}, ''), lambda c: ord(c))"
    data = f"flatten(list_transform({code}, lambda k: case when k < 128 then [k] else [192 + (k >> 6), 128 + (k & 63)] end))"
    bits = f"flatten(list_transform({data}, lambda b: list_transform(range(8), lambda i: ((b >> i) & 1)::bigint)))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: xor(c >> 1, ((xor(c, b) & 1) * 3988292384)::bigint)), 4294967295::bigint)"


_SPELLING_SQL = rf"""with recursive r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
c as (select doc_id, run, count(*) as n from r group by all),
h as (select run, n, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from c),
w as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2) else run end as word, n from h),
v as materialized (select word, sum(n)::bigint as n from w where length(word) >= 5 group by word having sum(n) >= 3),
x as (select word, n, unnest(range(1, length(word) + 1)) as k from v),
less as (select distinct x.word as a, v.word as b from x join v on v.word = substr(x.word, 1, k - 1) || substr(x.word, k + 1)),
mask as (select word, substr(word, 1, k - 1) || '_' || substr(word, k + 1) as m from x),
near as (select a, b from less union all select b, a from less union all select p.word, q.word from mask p join mask q on p.m = q.m and p.word <> q.word),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as form, max(n) as form_n from near join v on v.word = b group by a),
f as materialized (select v.word, case when form_n >= 2 * n then form end as form, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * n then form_n end as form_n from v left join best using (word)),
up(word, node) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.node where f.form is not null)
select f.word, f.form, up.node as root, f.n, f.n_near, f.form_n from f join up on up.word = f.word join f g on g.word = up.node and g.form is null"""

_TRIE_SQL = f"""with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place
  from conversations where conv_id is not null),
c as (select conv_id, {_crc32('conv_id::varchar')} % 9 as h, conv_id - conv_id % 5 as s from (select distinct conv_id from t)),
b as (select c.conv_id, 0 as part, place, r, x from c join t on t.conv_id = s and place < h union all select c.conv_id, 1, place, r, x from c join t on t.conv_id = c.conv_id and place >= h),
l as (select c.conv_id, coalesce(list({{'r': r, 'x': x}} order by part, place) filter (where r is not null), []) as u from c left join b on b.conv_id = c.conv_id group by c.conv_id),
p as (select conv_id, len(u) as total, d, u[1:d] as pre from (select conv_id, u, unnest(range(0, len(u) + 1)) as d from l)),
n as materialized (select pre, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when total = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from p group by pre, d),
k as (select pre[1:d - 1] as above, count(*) as n_children from n where d > 0 group by 1),
m as materialized (select n.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * strlen(pre[d].x) end as own from n left join k on k.above = n.pre),
s as (select pre[1:e] as top, count(*) filter (where n_children = 0) as n_leaves, sum(own)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as e from m) group by 1)
select m.conv_id, m.d::bigint as depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
from m join s on s.top = m.pre left join n q on m.d > 0 and q.pre = m.pre[1:m.d - 1]"""

#: The others are tested against brute force or a library; SQL can't express them.
ORACLES: dict[str, str] = {"op3_topk": _TOPK_SQL, "op5_urls": _URLS_SQL, "op9_warc": _WARC_SQL, "op10_minhash": _NEAR_SQL, "op12_spelling": _SPELLING_SQL, "op13_prefix_trie": _TRIE_SQL}
