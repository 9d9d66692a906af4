"""Registered queries of the text operators over the driver tables, each next to its SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from basketwise.llm import (
    bpe, curve_packing, fingerprint, langid, licenses, minhash, ngram_join, prefix_trie, rpforest, secret_scan, sharding,
    substring, whitening,
)
from basketwise.llm.tables import documents, table
from basketwise.plans.registry import Registry

R = Registry()


LEAVES = r"""list_transform(
    list_filter(string_split(regexp_replace({0}, '(\n|[.!?;:,|] )', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''),
    lambda x: CASE WHEN x = chr(10) THEN '1:' || repeat('0', 32) ELSE length(x) || ':' || sha256(x)[1:32] END)"""
ROOT = r"""sha256(array_to_string(list_transform(string_split(
    regexp_replace(array_to_string({0}, ' '), '([0-3]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: sha256(x)), ' '))"""
WEIGHT = "coalesce(list_sum(list_transform({0}, lambda x: split_part(x, ':', 1)::bigint)), 0)::bigint"
LIKENESS = (f"CASE WHEN {{0}} = {{1}} THEN 1.0::double ELSE coalesce(2.0::double * "
            f"{WEIGHT.format('list_distinct(list_intersect({0}, {1}))')} / "
            f"nullif({WEIGHT.format('list_distinct({0})')} + {WEIGHT.format('list_distinct({1})')}, 0), 0) END")

OP1_SQL = rf"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
pair AS (
  SELECT doc_id, text, n, n // 2 AS half,
    coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM own),
edit AS (SELECT *, text[1:n - half] || after[1:half] AS edited FROM pair),
tree AS (
  SELECT doc_id, n, edited, {LEAVES.format("text")} AS a, {LEAVES.format("edited")} AS b, {LEAVES.format("after")} AS c
  FROM edit)
SELECT doc_id, n::bigint AS n_chars, sha256(edited) AS edited_sha256, {ROOT.format("a")} AS fingerprint,
  {ROOT.format("b")} AS edited_fingerprint, {LIKENESS.format("a", "b")} AS near_edited,
  {LIKENESS.format("a", "c")} AS near_next,
  CASE WHEN a <> b THEN {WEIGHT.format(
      "a[1:coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i] = b[i], false)), false), 1) - 1]")} END
    AS edited_from
FROM tree
"""


@R.query("op1_merkle", OP1_SQL)
def op1_merkle(spark, sf):
    return fingerprint.compare_with_edit(documents(spark, sf))


@R.query("op2_langid")
def op2_langid(spark, sf):
    docs = documents(spark, sf)
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", (~langid.learnable(out)).alias("held_out"), "lang_pred", "score")


@R.query("op3_rpforest")
def op3_rpforest(spark, sf):
    return rpforest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


WORD_LIST = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4_SQL = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, {WORD_LIST.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM word),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
member AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS overlap
  FROM member a JOIN member b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * overlap >= 80 * (x.n + y.n - overlap)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (
  SELECT doc_id, doc_id AS c FROM sizes
  UNION
  SELECT edge.u, reach.c FROM reach JOIN edge ON edge.v = reach.doc_id)
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


@R.query("op4_minhash", OP4_SQL)
def op4_minhash(spark, sf):
    return minhash.near_duplicates(documents(spark, sf), minhash.NearDupSpec(shingle=2)).select(
        "doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id", "kept")


OP5_SQL = rf"""
WITH word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p
  FROM (SELECT doc_id, {WORD_LIST.format("coalesce(text, '')")} AS w FROM documents)),
win AS (
  SELECT doc_id, p, x, string_agg(x, ' ') OVER ahead AS g, count(*) OVER ahead AS size FROM word
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
marked AS (
  SELECT doc_id, p, x, size = 20 AND row_number() OVER (PARTITION BY g, size ORDER BY doc_id, p) > 1 AS again FROM win),
covered AS (
  SELECT doc_id, p, x, max(again::int) OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM marked),
done AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (gone = 0) AS kept
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id
"""


@R.query("op5_substring", OP5_SQL)
def op5_substring(spark, sf):
    out = substring.remove_repeats(documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@R.query("op6_byte_bpe")
def op6_byte_bpe(spark, sf):
    out = bpe.encode_documents(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN, ids_as_text=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@R.query("op8_curve_packing")
def op8_curve_packing(spark, sf):
    out = curve_packing.pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset")


@R.query("op7_secret_scan")
def op7_secret_scan(spark, sf):
    out = secret_scan.scan(documents(spark, sf))
    return out.select("doc_id", "word_no", F.col("part").cast("long").alias("part"),
                      F.col("length").cast("long").alias("length"), F.sha2("secret", 256).alias("secret_sha256"),
                      "probability", "is_secret")


SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 2053

OP9_SQL = rf"""
WITH RECURSIVE shard AS (
  SELECT i, printf('shard-%02d', i) AS name FROM range(32) t(i)),
pick AS (
  SELECT name, i, ('0x' || md5(name || ':offset')[1:15])::bigint % {SLOTS} AS spot,
    ('0x' || md5(name || ':skip')[1:15])::bigint % ({SLOTS} - 1) + 1 AS skip FROM shard),
plan AS (SELECT list(spot ORDER BY i) AS spots, list(skip ORDER BY i) AS skips FROM pick),
-- one row per claim: the first slot in the preference order of the shard whose turn it is that is still free
claim AS (
  SELECT 0 AS turn, NULL::bigint AS slot, []::bigint[] AS taken
  UNION ALL
  SELECT turn + 1, free.slot, list_append(taken, free.slot)
  FROM claim, plan, LATERAL (
    SELECT list_filter(list_transform(range(0, {SLOTS}), lambda k: (spots[turn % 32 + 1] + k * skips[turn % 32 + 1]) % {SLOTS}),
                       lambda s: NOT list_contains(taken, s))[1] AS slot) free
  WHERE turn < {SLOTS}),
slots AS (SELECT slot, printf('shard-%02d', (turn - 1) % 32) AS shard FROM claim WHERE turn > 0),
doc AS (SELECT doc_id, ('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shard FROM doc JOIN slots USING (slot)
"""


@R.query("op9_sharding", OP9_SQL)
def op9_sharding(spark, sf):
    docs = documents(spark, sf).select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS, SLOTS).select("doc_id", "slot", "shard")


_TEMPLATES = " UNION ALL ".join(
    f"SELECT '{name}' AS license, '{text.replace(chr(39), chr(39) * 2)}' AS wording"
    for name, text in sorted(licenses.TEMPLATES.items()))
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_PAIRS = ("list_distinct(list_transform(range(1, len(string_split({0}, ' '))), "
          "lambda i: string_split({0}, ' ')[i] || ' ' || string_split({0}, ' ')[i + 1]))")

OP10_SQL = rf"""
WITH template AS (
  SELECT license, {_PAIRS.format("wording")} AS t
  FROM (SELECT license, {_NORMAL.format("wording")} AS wording FROM ({_TEMPLATES}))),
part AS (
  SELECT doc_id, unnest(list_concat([text], string_split_regex(text, '\n\s*\n'), string_split(text, chr(10)),
    string_split_regex(text, '[.!?]\s+'))) AS p FROM documents WHERE text IS NOT NULL),
passage AS (SELECT DISTINCT doc_id, {_NORMAL.format("p")} AS passage FROM part),
pairs AS (SELECT doc_id, passage, {_PAIRS.format("passage")} AS p FROM passage),
dice AS (
  SELECT doc_id, passage, license, len(p) AS bigrams, 2.0::double * len(list_intersect(p, t)) / (len(p) + len(t)) AS dice
  FROM pairs, template WHERE len(p) > 0)
SELECT doc_id, license, dice, bigrams::bigint AS bigrams, passage FROM dice WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license) = 1
"""


@R.query("op10_licenses", OP10_SQL)
def op10_licenses(spark, sf):
    # runs of words reach further than the passages of the SQL, which must all be among the rows
    return licenses.scan(documents(spark, sf), anywhere=True)


OP11_SQL = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, {WORD_LIST.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM word),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
member AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS overlap
  FROM member a JOIN member b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * overlap >= 90 * (x.n + y.n - overlap)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (
  SELECT doc_id, doc_id AS c FROM sizes
  UNION
  SELECT edge.u, reach.c FROM reach JOIN edge ON edge.v = reach.doc_id)
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


@R.query("op11_ngram_join", OP11_SQL)
def op11_ngram_join(spark, sf):
    return ngram_join.linked_documents(documents(spark, sf), ngram_join.JoinSpec(shingle=3, percent=90))


@R.query("op12_whitening")
def op12_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


# CRC-32 of the decimal id, bit by bit
CRC32 = """xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::bigint)"""

OP13_SQL = rf"""
WITH ordered AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
part AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM ordered),
talk AS (
  SELECT part.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), coalesce(list_slice(part.own, h + 1, len(part.own)), [])) AS turns
  FROM part LEFT JOIN ordered b ON b.conv_id = base),
prefix AS (
  SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth, turns FROM talk),
member AS (SELECT conv_id, depth, length, list_slice(turns, 1, depth) AS path FROM prefix),
node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM member GROUP BY depth, path),
family AS (
  SELECT p.depth, p.path, count(*) AS n_children FROM node p JOIN node c
  ON c.depth = p.depth + 1 AND list_slice(c.path, 1, p.depth) = p.path GROUP BY 1, 2),
valued AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN node.depth = 0 THEN 0 ELSE (n_convs - 1) * length(node.path[node.depth].t) END AS saved
  FROM node LEFT JOIN family USING (depth, path)),
total AS (
  SELECT top.depth, top.path, count(*) FILTER (low.n_children = 0) AS n_leaves, sum(low.saved)::bigint AS saved_tokens
  FROM valued top JOIN valued low ON low.depth >= top.depth AND list_slice(low.path, 1, top.depth) = top.path
  GROUP BY 1, 2)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN total USING (depth, path)
LEFT JOIN node up ON up.depth = v.depth - 1 AND up.path = list_slice(v.path, 1, v.depth - 1)
"""


@R.query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))


@R.query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)


QUERIES = dict(R.queries)
ORACLES = dict(R.oracles)
