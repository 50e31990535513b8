"""Registered queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokens
from .bit_sliced import top_k
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .jaccard_join import jaccard_components
from .licenses import TEMPLATES, WORD_CLASS, scan_licenses, scan_notices
from .mixing import ADD, BLOCK_WORDS, PRIME, ROUNDS, Mix
from .prefix_trie import conversation_trie
from .pieces import encode_occurrences, model_path
from .repeated_windows import remove_repeats
from .toxicity import held_out, toxicity
from .url_lists import host_of, first_segment, judge
from .winnowing import decontaminate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build
    return add


@register("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2*p+1, 100) AS s FROM d, unnest(range(0, length(h)//2-49)) AS t(p)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (s) WHERE least < doc_id),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p)+50 AS z FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low FROM r),
t AS (SELECT doc_id, string_agg(substr(h, 2*low+1, 2*(a-low)), '' ORDER BY a) || substr(any_value(h), 2*max(z)+1) AS kept, count(*) AS n_spans, sum(z-a) AS n_removed FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h)//2)::BIGINT AS n_bytes, coalesce(n_removed,0)::BIGINT AS n_removed, coalesce(n_spans,0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept,h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""")
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, span: total + span["end"] - span["start"])
    return cut.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("""
WITH d AS (SELECT doc_id, length(coalesce(text,'')) AS points, sha256(regexp_replace(coalesce(text,''),'[\\x20\\x09-\\x0D]','','g')) AS text_sha256 FROM documents),
o AS (SELECT text_sha256, count(*)::BIGINT AS group_size, first(doc_id ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN o USING (text_sha256)""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@register("""
WITH RECURSIVE w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\\x20\\x09-\\x0D]+',' ','g')),' ') AS ws FROM documents),
v AS (SELECT doc_id, list_filter(ws, lambda x: x <> '') AS ws FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3],' ') AS g FROM v, unnest(range(1, greatest(len(ws)-3,1)+1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1,2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 85*(x.n+y.n-c)),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, k.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) k ON k.id = d.doc_id""")
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), n=4, num=85, den=100)


@register("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]*p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""")
def op4_bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


def _number(key, mark: str):
    """A number that a key gets on both sides of a comparison."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(mark), key)), 1, 6), 16, 10).cast("bigint")


def list_history(pages: DataFrame) -> DataFrame:
    """A history of a list about the hosts, domains and sections of the pages, as the tables hold none.

    A third of the keys is listed, at a day that follows from the key, taken off after 40 days and listed again 80 days later.
    """
    host, section = host_of(F.col("url")), first_segment(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    keys = (pages.where(host != "").select(F.explode(F.array(F.struct(host.alias("key"), F.lit("host ").alias("mark")), F.struct(domain.alias("key"), F.lit("domain ").alias("mark")),
            F.struct(F.concat_ws("/", host, section).alias("key"), F.lit("section ").alias("mark")))).alias("k")).select("k.*").where("key <> ''").distinct())
    number = _number(F.col("key"), "n")
    listed = keys.withColumn("n", number + F.length("mark")).where("n % 3 = 0")
    action = F.when(F.expr("n % 9 = 3"), "allow").otherwise("block")
    steps = F.array(*[F.struct((F.col("n") % 300 + later).alias("day"), what.alias("action"), (F.lit(order) * 10 + F.length("mark")).alias("seq"))
                      for order, later, what in ((1, 0, action), (2, 40, F.lit("remove")), (3, 120, F.lit("block")))])
    return listed.withColumn("step", F.explode(steps)).select("key", "step.day", "step.action", "step.seq")


@register("""
WITH p AS (SELECT page_id, url, (page_id * 37) % 365 AS day, lower(regexp_extract(coalesce(url,''),'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)',1)) AS host,
  regexp_extract(coalesce(url,''),'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)',1) AS seg FROM pages),
k AS (SELECT host AS key, 5 AS m FROM p WHERE host <> '' UNION SELECT regexp_extract(host,'([^.]+\\.[^.]+\\.[^.]+)$',1), 7 FROM p WHERE host <> ''
  UNION SELECT host||'/'||seg, 8 FROM p WHERE host <> ''),
n AS (SELECT key, m, ('0x'||substr(md5('n'||key),1,6))::BIGINT + m AS n FROM k WHERE key <> ''),
e AS (SELECT key, n % 300 AS day, CASE WHEN n % 9 = 3 THEN 'allow' ELSE 'block' END AS action, 10+m AS seq FROM n WHERE n % 3 = 0
  UNION ALL SELECT key, n % 300 + 40, 'remove', 20+m FROM n WHERE n % 3 = 0 UNION ALL SELECT key, n % 300 + 120, 'block', 30+m FROM n WHERE n % 3 = 0),
x AS (SELECT key, day AS since, arg_max(action, seq) AS action, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM e GROUP BY key, day),
q AS (SELECT page_id, url, day, host, unnest(list_distinct(list_concat(CASE WHEN seg <> '' THEN [host||'/'||seg] ELSE [] END,
  list_transform(range(1, greatest(len(string_split(host,'.'))-1,1)+1), lambda i: array_to_string(string_split(host,'.')[i:],'.'))))) AS key FROM p WHERE host <> '' AND day IS NOT NULL),
h AS (SELECT q.*, action, since FROM q JOIN x USING (key) WHERE action <> 'remove' AND day >= since AND (until IS NULL OR day < until)
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC) = 1)
SELECT p.page_id, p.url, p.day, p.host, coalesce(h.action = 'block', false) AS blocked, h.key AS matched_key, h.action, coalesce(h.since,-1)::BIGINT AS since
FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url = h.url""")
def op5_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against the entries active on the day of its fetch; the table has no such day, so it follows from page_id."""
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") * 37 % 365).alias("day"))
    return judge(captures, list_history(pages)).withColumn("since", F.coalesce("since", F.lit(-1)).cast("bigint"))


def _mixed_sql(v: str) -> str:
    return f"((({v}) % {PRIME}) * ((({v}) + {ADD}) % {PRIME})) % {PRIME}"


@register(f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''),'[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  {_mixed_sql(_mixed_sql(f'(doc_id % {PRIME})'))} % greatest(64, (SELECT count(*)//10000 FROM documents)) AS part FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s GROUP BY source),
b AS (SELECT *, [3.0,1.0,2.0][((src-1)%3+1)::INT]::DOUBLE AS weight, 2.0*source_size AS most FROM a),
c AS (SELECT *, (1.5*sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most/weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))
  / sum(weight) OVER (ORDER BY most/weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
t AS (SELECT src, source, source_size, least(most, coalesce((SELECT max(level) FROM c WHERE level <= most/weight),0)*weight)::DOUBLE AS target,
  ceil(source_size/{BLOCK_WORDS}.0)::BIGINT AS n FROM c),
u AS (SELECT *, round(target)::BIGINT // greatest(source_size,1) AS passes, round(target)::BIGINT % greatest(source_size,1) AS rest FROM t),
v AS (SELECT u.*, pass, list_transform(range(0, {ROUNDS}), lambda r: {_mixed_sql(_mixed_sql(_mixed_sql('(src*69069 + pass*10007 + 17*1000003 + r*104729)')))}) AS keys
  FROM u, unnest(range(0, passes+1)) AS p(pass) WHERE n > 0),
o AS (SELECT *, list_reduce(list_prepend(k, keys), lambda x, y: CASE WHEN ({_mixed_sql('(greatest(x, (y % n + n - x) % n) + y)')} >> 15) % 2 = 1 THEN (y % n + n - x) % n ELSE x END) AS block,
  source_size-(n-1)*{BLOCK_WORDS} AS tail FROM v, unnest(range(0, n)) AS q(k)),
h AS (SELECT *, max(CASE WHEN block = n-1 THEN k END) OVER (PARTITION BY src, pass) AS short FROM o),
f AS (SELECT *, k*{BLOCK_WORDS} - CASE WHEN k > short THEN {BLOCK_WORDS}-tail ELSE 0 END AS before, CASE WHEN block = n-1 THEN tail ELSE {BLOCK_WORDS} END AS length FROM h),
w AS (SELECT src, block, CASE WHEN pass < passes THEN length ELSE least(length, rest-before) END AS take FROM f),
d AS (SELECT s.*, src, source_size, target, n, (sum(size) OVER (PARTITION BY s.source ORDER BY part, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source),
m AS (SELECT d.doc_id, sum(greatest(0, least(stop, block*{BLOCK_WORDS}+take) - greatest(stop-size, block*{BLOCK_WORDS})))::BIGINT AS taken
  FROM d JOIN w ON d.src = w.src AND take > 0 AND block*{BLOCK_WORDS} < stop AND (block+1)*{BLOCK_WORDS} > stop-size GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken,0)::BIGINT AS taken FROM d LEFT JOIN m USING (doc_id)""")
def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(table(spark, folder, "documents")).counts()


def _license_sql() -> str:
    low = lambda x: f"translate({x},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all({low(x)}, '{WORD_CLASS}')"
    rows = ", ".join(f"('{name}', '{text}')" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH t(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words('text')} AS w FROM t),
tb AS (SELECT DISTINCT license, w[i]||' '||w[i+1] AS g FROM tw, unnest(range(1, len(w))) AS u(i)),
tn AS (SELECT license, count(*) AS n FROM tb GROUP BY 1),
d AS (SELECT doc_id, coalesce(text,'') AS text FROM documents),
p AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS text FROM d, unnest(range(1, len(string_split(text, chr(10)))+1)) AS u(i)
  UNION ALL SELECT doc_id, 0, text FROM d WHERE contains(text, chr(10))),
pw AS (SELECT doc_id, line, {words('text')} AS w FROM p),
pb AS (SELECT DISTINCT doc_id, line, w[i]||' '||w[i+1] AS g FROM pw, unnest(range(1, len(w))) AS u(i)),
pn AS (SELECT doc_id, line, count(*) AS n FROM pb GROUP BY 1,2),
c AS (SELECT doc_id, line, license, count(*) AS c FROM pb JOIN tb USING (g) GROUP BY 1,2,3),
s AS (SELECT doc_id, line, license, 2*c/(pn.n+tn.n)::DOUBLE AS dice FROM c JOIN pn USING (doc_id, line) JOIN tn USING (license) WHERE 2*c >= 0.8*(pn.n+tn.n))
SELECT doc_id, line::INT AS line, license, dice FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1"""


@register(_license_sql())
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


@register()
def op7_license_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Notices over several lines and within lines; the SQL of ``op7_license_scan`` knows lines and whole texts only."""
    return scan_notices(table(spark, folder, "documents"))


@register()
def op8_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@register()
def op9_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


@register()
def op10_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_occurrences(table(spark, folder, "documents"), model_path())
    return encoded.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "lossless")


@register()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), model_path("byte_bpe_50k.json"), model_path(), with_links=False)


def _trie_sql() -> str:
    steps = [0] * 16
    for n in range(16):
        steps[n] = n
        for _ in range(4):
            steps[n] = steps[n] >> 1 ^ (0xEDB88320 if steps[n] & 1 else 0)
    nibbles = "list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR)+1), lambda i: [(ascii(substr(c::VARCHAR,i::INT,1)) & 15)::BIGINT, (ascii(substr(c::VARCHAR,i::INT,1)) >> 4)::BIGINT])))"
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) - 1 AS pos,
  md5(length(coalesce(role,''))||':'||coalesce(role,'')||coalesce(text,'')) AS k, strlen(coalesce(text,''))::BIGINT AS bytes FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS len, c - c % 5 AS base FROM t GROUP BY c),
h AS (SELECT *, xor(list_reduce({nibbles}, lambda a, b: xor(a >> 4, ({steps}::BIGINT[])[(xor(a, b) & 15) + 1])), 4294967295) % 9 AS h FROM n),
v AS (SELECT h.c, h.h, h.base, least(h.h, coalesce(b.len,0)) AS m, least(h.h, coalesce(b.len,0)) + greatest(h.len - h.h, 0) AS n_turns FROM h LEFT JOIN n b ON b.c = h.base),
r AS (SELECT v.c, m + pos - h + 1 AS depth, k, bytes, n_turns FROM t JOIN v ON t.c = v.c WHERE pos >= h UNION ALL SELECT v.c, pos + 1, k, bytes, n_turns FROM t JOIN v ON t.c = v.base WHERE pos < h),
p AS (SELECT c, depth, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS k, bytes, n_turns FROM r UNION ALL SELECT c, 0, '', 0, n_turns FROM v),
o AS (SELECT depth, k, min(c) AS conv_id, count(*)::BIGINT AS n_convs, max(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n_turns), '') AS ends FROM p GROUP BY depth, k),
q AS (SELECT o.*, u.conv_id AS parent_conv_id, u.k AS up FROM o LEFT JOIN p ON p.c = o.conv_id AND p.depth = o.depth - 1 LEFT JOIN o u ON u.depth = p.depth AND u.k = p.k),
d AS (SELECT depth - 1 AS depth, up AS k, count(*)::BIGINT AS n_children FROM q WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT q.*, coalesce(n_children,0)::BIGINT AS n_children FROM q LEFT JOIN d USING (depth, k)),
s AS (SELECT p.depth, p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs-1)*x.bytes)::BIGINT AS saved_tokens FROM x JOIN p ON p.c = x.conv_id AND p.depth <= x.depth GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM x JOIN s USING (depth, k)"""


@register(_trie_sql())
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


@register("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
n AS (SELECT item_id, ws, least(len(ws),10) AS t FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, t, array_to_string(ws[i:i+t-1],' ') AS g FROM n, unnest(range(1, len(ws)-t+2)) AS u(i)),
k AS (SELECT DISTINCT t FROM w),
x AS (SELECT doc_id, i AS s, t, array_to_string(ws[i:i+t-1],' ') AS g FROM d, k, unnest(range(1, len(ws)-t+2)) AS u(i)),
h AS (SELECT doc_id, s, t, item_id FROM x JOIN w USING (t, g)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM h, unnest(range(s, s+t)) AS v(p) GROUP BY 1),
l AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*)::BIGINT AS n_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN l ON d.doc_id = l.doc_id""")
def op13_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, span: total + span["end"] - span["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
