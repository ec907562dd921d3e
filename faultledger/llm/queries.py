"""The queries of this subpackage over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultledger.llm import ann, byte_bpe, exact_topk, html_text, language_id, line_dedup, mixing, pii, prefix_trie, simhash, substring_dedup, url_filter, whitening
from faultledger.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def bpe_round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(vocabulary))
    ids = byte_bpe.bpe_encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"), every=100, k=10).drop("exact")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: Share of a source's documents beyond which a line is boilerplate, and documents it must stand on.
#: A site is laid out by tens of templates and sections, each with its own header and footer, so a
#: line of one of them stands on few of the site's pages; on one in a hundred it is no chance.
LINE_RATIO, LINE_PAGES = 0.01, 5


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, with the source as the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.drop_lines(docs, host="source", ratio=LINE_RATIO, min_pages=LINE_PAGES, lines="n_lines", dropped="n_dropped")
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed patterns' spans; ``spans`` has those of the field too."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda span: span["base"])
    of_kind = F.transform(base, lambda span: span["kind"])
    counts = [(F.size(of_kind) - F.size(F.array_remove(of_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_components(table(spark, sf_dir, "documents"), size=3, max_bits=3)
    fingerprint = F.lpad(F.lower(F.hex("simhash")), 16, "0")
    return groups.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def held_out() -> Column:
    """Rows whose language no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.where(~held_out()), key="doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return language_id.predict(texts, language_model(docs)).drop("text")


#: Entries (host, path) of the URL filter, fixed by the query.
BLOCKED = [("net", "/"), ("example.com", "/de/")]
ALLOWED = [("example.net", "/en/"), ("org", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, BLOCKED, ALLOWED).drop("url")


def grid(vector: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of every component; null for a component that no long can hold, or that is not finite."""
    place = lambda c: F.floor(c * scale) + offset
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < 2.0**53, place(c.cast("double"))))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector and component; vectors with an entry of 2**53 or more can't be put on the grid and are left out."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", grid("embedding").alias("x"))
    rows = whitening.usable(vectors, "x")
    model = whitening.fit(rows, "x", components=32)
    names = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], names)
    error = whitening.identity_error(rows, "x", model)
    out = whitening.whiten(rows, "x", model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(share)) for share in model.explained)).cast("array<double>")
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with turns of the one whose id is the next multiple of 5 towards 0."""
    conv = F.col("conv_id")
    lead = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), donor=conv - conv % 5, lead=lead)


QUERIES: dict[str, Query] = {
    "op1_ann": op1_ann,
    "op2_language_id": op2_language_id,
    "op3_html_text": op3_html_text,
    "op4_mixing": op4_mixing,
    "op5_exact_topk": op5_exact_topk,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pii": op8_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_mixing": r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), ' ', coalesce(text, ''))), 1, 12) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (
  select *, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
  from s),
f as (
  select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over before, 0) as left_weight
  from r window before as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
l as (
  select rest, left_weight from f where rest * weight <= 3 * source_size * left_weight
  order by source_size / weight, source is null, source limit 1),
t as (
  select f.source, f.source_size, case when f.rest * weight <= 3 * source_size * f.left_weight
    then cast(l.rest * weight as double) / cast(l.left_weight as double) else cast(3 * source_size as double) end as target
  from f cross join l),
x as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end as f_times from t),
b as (select *, target - f_times * source_size as budget from x),
g as (select source, h, sum(size) as words, count(*) as n from d group by source, h),
c as (select *, sum(words) over (partition by source order by h) as through from g),
e as (
  select c.source, min(c.h) as h from c join b on c.source is not distinct from b.source
  where c.through > b.budget group by c.source),
k as (
  select e.source, e.h, ceil((b.budget - (c.through - c.words)) * c.n / c.words - 0.5) as more
  from e join c on c.source is not distinct from e.source and c.h = e.h
  join b on b.source is not distinct from e.source),
p as (select *, row_number() over (partition by source, h order by doc_id) as place from d)
select d.doc_id, d.size, b.source_size, b.target,
  cast(d.size * (b.f_times + case when k.h is null or d.h < k.h or (d.h = k.h and d.place <= k.more) then 1 else 0 end) as bigint) as taken
from p d join b on b.source is not distinct from d.source left join k on k.source is not distinct from d.source""",
    "op5_exact_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op6_line_dedup": f"""
with d as (select doc_id, source, text, string_split(text, chr(10)) as every from documents),
u as (
  select source, unnest(list_distinct(list_filter(list_transform(every, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) as line
  from d),
c as (select source, line, count(*) as pages from u group by source, line),
p as (select source, count(*) as total from d group by source),
b as (
  select c.source, list(c.line) as gone from c join p on c.source is not distinct from p.source
  where c.pages >= {LINE_PAGES} and c.pages > p.total * {LINE_RATIO} group by c.source),
k as (
  select d.*, list_filter(d.every, lambda x: not list_contains(coalesce(b.gone, []), trim(x, ' ' || chr(9) || chr(13)))) as kept
  from d left join b on b.source is not distinct from d.source),
m as (
  select *, len(list_filter(kept, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0 and len(kept) < len(every) as changed
  from k)
select doc_id, case when changed then array_to_string(kept, chr(10)) else text end as text,
  cast(coalesce(len(list_filter(every, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')), 0) as bigint) as n_lines,
  cast(case when changed then len(every) - len(kept) else 0 end as bigint) as n_dropped
from m""",
    "op7_substring_dedup": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
x as (
  select doc_id, i, array_to_string(words[i:i + 49], ' ') as said
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
f as (select said, min(doc_id) as owner from x group by said),
g as (
  select distinct doc_id, unnest(range(i, i + 50)) as place
  from x join f using (said) where owner < doc_id),
p as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from w),
k as (
  select p.doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n_kept
  from p anti join g using (doc_id, place) group by p.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)""",
    "op12_url_filter": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (
  select page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path
  from h),
r as (
  select *, case
    when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
    when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from r""",
    "op13_prefix_trie": r"""
with said as (
  select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x
  from conversations where conv_id is not null),
ids as (select r, x, row_number() over () as id, strlen(x) as bytes from (select distinct r, x from said)),
own as (
  select c, list(id order by turn nulls first, sha256(strlen(r) || ':' || r || x)) as s
  from said join ids using (r, x) group by c),
crc_table as (
  select list(list_reduce(list_concat([i], range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
  from range(256) g(i)),
leads as (
  select c, s, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(cast(c as varchar), ''), lambda a: cast(ascii(a) as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h
  from own, crc_table),
built as (
  select l.c, list_concat(coalesce(d.s[1:h], []), l.s[h + 1:]) as s
  from leads l left join own d on d.c = l.c - l.c % 5),
paths as (select c, s[1:d] as p, d from (select c, s, unnest(range(0, len(s) + 1)) as d from built)),
nodes as (
  select p, min(c) as conv_id, max(d) as depth, count(*) as n, coalesce(max(i.bytes), 0) as bytes
  from paths left join ids i on i.id = p[d] group by p),
kids as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by 1),
up as (
  select p[1:k] as p, leaf, saved
  from (select nodes.p, unnest(range(0, depth + 1)) as k, (n_children is null)::bigint as leaf, (n - 1) * bytes as saved from nodes left join kids using (p))),
sums as (select p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from up group by p),
ends as (select s as p, string_agg(cast(c as varchar), ',' order by c) as ends from built group by s)
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes n left join kids using (p) join sums using (p) left join ends using (p)
left join nodes q on n.depth > 0 and q.p = n.p[1:n.depth - 1]""",
}
