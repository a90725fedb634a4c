"""The registered queries opN_<name>: (Spark query, SQL check or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe, binary, decontaminate, language, licenses, neardup, pii, sharding, spelling, tokens, turns, vectors,
               warc)
from .common import table


def op1_wu_manber_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL.format(text="text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL.format(text="text")} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS width,
           array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
           FROM (SELECT d.doc_id, d.w, x.width, unnest(range(1, len(d.w) - x.width + 2)) AS i
                 FROM d, (SELECT DISTINCT width FROM wins) x)),
hits AS (SELECT p.doc_id, p.i, p.width, wins.item FROM places p JOIN wins USING (win, width)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM hits)
          GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op2_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to
FROM r"""


def op3_language_by_compression(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op4_separator_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_ordered_license_rules(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_word_shape_field_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op7_distinct_word_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_count_vector_jaccard_join(spark, sf_dir):
    return neardup.join(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> ''), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


def op9_segment_statistics_top_k(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op10_lookup_table_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"), ["doc_id"], sharding.fill_table(sharding.shard_names()))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; needs crc_table in scope."""
    return f"""xor(list_reduce(list_transform(range(0, strlen({text})), lambda i:
      CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


CRC_TABLE = """crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crcs)"""


def op11_asymmetric_chunk_spelling(spark, sf_dir):
    """Words of all documents, some of whose runs lose a character, with their forms and roots."""
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run").cast("binary"))
    at = (crc % F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    struck = F.col("doc_id").isNotNull() & (crc % 31 == 0)
    words = spelling.count_words(runs.select(F.when(struck, less).otherwise(F.col("run")).alias("word")))
    return spelling.group(words)


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, k, {crc32_sql("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM r, crc_table),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
      AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -near_n, near := near)) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, CASE WHEN -best.m >= 10 * n THEN best.near END AS form, n,
       coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, form AS next FROM f
      UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL"""


def op12_branch_and_bound_turns(spark, sf_dir):
    """The conversations, damaged by a checksum of each row's place, and what it costs to repair them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    crc = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                                                        crc.alias("fate"))
    damaged = rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))))
    return turns.report(damaged, dropped="gone")


def op12_sql() -> str:
    """The repair as a fold over the turns: per state of the pattern the least (cost, audit), then what it gives."""
    def step(x, cost, letter, item="''"):
        end = f"instr({x}, chr(1))"
        return (f"(lpad(CAST(CAST(substr({x}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({x}, 9, {end} - 9)"
                f" || '{letter}' || substr({x}, {end}) || {item})")

    def best(*options):
        return f"least({', '.join(options)})"

    def stay(state, role):
        """Keep or rerole the turn, coming from that state."""
        return (f"CASE WHEN t.i IN ('blank', 'duplicate') THEN NULL WHEN t.role[1] = '{role[0]}' THEN "
                + step(f"c.{state}", "t.e", "K", "chr(10) || t.role || ':' || t.text") + " ELSE "
                + step(f"c.{state}", "2 + t.e", "R", f"chr(10) || '{role}:' || t.text") + " END")

    deleted = {s: step(f"c.{s}", 3, "D") for s in "zsua"}
    system = ("CASE WHEN t.i NOT IN ('blank', 'duplicate') AND t.role[1] = 's' THEN "
              + step("c.z", "t.e", "K", "chr(10) || t.role || ':' || t.text") + " END")
    turn = {"z": deleted["z"], "s": best(deleted["s"], system),
            "u": best(deleted["u"], *[stay(s, "user") for s in "zsa"]), "a": best(deleted["a"], stay("u", "assistant"))}
    insert = {"z": "c.z", "s": "c.s", "u": best("c.u", *[step(f"c.{s}", 2, "I", "chr(10) || 'user:'") for s in "zsa"]),
              "a": best("c.a", step("c.u", 2, "I", "chr(10) || 'assistant:'"))}
    states = ", ".join(f"{s} := CASE WHEN t.i = 'insert' THEN {insert[s]} ELSE {turn[s]} END" for s in "zsua")
    blank = r"\x20\x09-\x0D"
    null = "CAST(NULL AS VARCHAR)"
    item = "struct_pack(i := {}, e := {}, role := {}, text := {}, " + f"z := {null}, s := {null}, u := {null}, a := {null})"
    start = f"struct_pack(i := '', e := 0, role := '', text := '', z := '00000000' || chr(1), s := {null}, u := {null}, a := {null})"
    return rf"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h
      FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS twin FROM o WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), twin) AS place FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{blank}]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][{blank}]*\z') THEN 'truncated' ELSE '' END AS fault,
      CASE WHEN place > 1 THEN lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] END AS pair FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({item.format("fault", "CAST(fault = 'truncated' AS INTEGER)", "role", "text")} ORDER BY place) AS rows
      FROM f GROUP BY 1),
x AS (SELECT * EXCLUDE (rows), flatten(list_transform(rows, lambda q: [{item.format("'insert'", "0", "''", "''")}, q]))
        || [{item.format("'insert'", "0", "''", "''")}] AS rows FROM g),
y AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda c, t: struct_pack(i := '', e := 0, role := '', text := '', {states}),
        {start}) AS c FROM x),
z AS (SELECT * EXCLUDE (c), least(c.z, c.a) AS best FROM y)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(best, 1, 8) AS BIGINT), 0) AS cost, coalesce(substr(best, 9, instr(best, chr(1)) - 9), '') AS audit,
  sha256(coalesce(substr(best, instr(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""


def op13_binary_token_ids(spark, sf_dir):
    return binary.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_wu_manber_decontamination": (op1_wu_manber_decontamination, OP1_SQL),
    "op2_warc_round_trip": (op2_warc_round_trip, OP2_SQL),
    "op3_language_by_compression": (op3_language_by_compression, None),
    "op4_separator_token_counts": (op4_separator_token_counts, None),
    "op5_ordered_license_rules": (op5_ordered_license_rules, None),
    "op6_word_shape_field_pii": (op6_word_shape_field_pii, None),
    "op7_distinct_word_bpe": (op7_distinct_word_bpe, None),
    "op8_count_vector_jaccard_join": (op8_count_vector_jaccard_join, OP8_SQL),
    "op9_segment_statistics_top_k": (op9_segment_statistics_top_k, OP9_SQL),
    "op10_lookup_table_sharding": (op10_lookup_table_sharding, None),
    "op11_asymmetric_chunk_spelling": (op11_asymmetric_chunk_spelling, OP11_SQL),
    "op12_branch_and_bound_turns": (op12_branch_and_bound_turns, op12_sql()),
    "op13_binary_token_ids": (op13_binary_token_ids, None),
}
