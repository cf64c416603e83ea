"""The queries of this subpackage, each an operator over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .alignment import align_tokenizers
from .ann import nearest
from .decontaminate import find_leaks
from .langid import identify_languages
from .licences import APART, COPYRIGHT, KNOWN, SPELLINGS, scan_licences
from .mixing import mix_plan
from .packing import packed_pieces
from .repeats import remove_repeats, repeat_digest
from .secret_scan import scan_secrets, secret_digest
from .sharding import regular_tree, shard, with_region
from .simhash import simhash_components
from .tokens import tokens_of
from .trie import conversation_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = ready
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark, d):
    return simhash_components(table(spark, d, "documents"))


@query("op3_mixing", r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
              FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
                   row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sources),
level AS (SELECT *, (sum(source_size) OVER ()
                     - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                    * weight > cap AS cut FROM weighed),
rest AS (SELECT sum(source_size) - coalesce(sum(cap) FILTER (cut), 0) AS words, sum(weight) FILTER (NOT cut) AS weight FROM level),
targets AS (SELECT source, source_size,
                   CASE WHEN cut THEN cap::DOUBLE ELSE rest.words / rest.weight * level.weight END AS target,
                   ('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
            FROM level, rest),
placed AS (SELECT rows.*, source_size, target, start,
                  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                  row_number() OVER (PARTITION BY rows.source ORDER BY size, doc_id) - 1 AS pos
           FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       ((floor(start + (pos + 1) * rate) - floor(start + pos * rate)) * size)::BIGINT AS taken FROM placed
""")
def op3(spark, d):
    plan = mix_plan(table(spark, d, "documents"))
    return plan.select(F.col("__id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


@query("op5_sharding")
def op5(spark, d):
    tree = regular_tree(24)
    return shard(table(spark, d, "documents"), tree, with_region(tree))


_SHINGLES = r"""SELECT DISTINCT id, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM
          (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
           FROM {table}) WHERE len(w) > 0)"""


@query("op6_decontamination", f"""
WITH item AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
doc AS ({_SHINGLES.format(id="doc_id", table="documents")}),
size AS (SELECT id, count(*) AS n FROM item GROUP BY id)
SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS matched, any_value(n) AS n_shingles, count(*) / any_value(n) AS containment
FROM item JOIN doc ON item.s = doc.s JOIN size ON size.id = item.id GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.8
""")
def op6(spark, d):
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(F.col("__id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "n_shingles", "containment")


@query("op9_secrets")
def op9(spark, d):
    return secret_digest(scan_secrets(table(spark, d, "documents")))


@query("op2_language_id")
def op2(spark, d):
    return identify_languages(table(spark, d, "documents"))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_token_files")
def op4(spark, d):
    return tokens_of(table(spark, d, "documents"), public_tokenizer())


@query("op10_nearest_neighbours")
def op10(spark, d):
    return nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_repeated_passages")
def op7(spark, d):
    return repeat_digest(remove_repeats(table(spark, d, "documents")))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licence_sql() -> str:
    spelled = "wide"
    for variant, usual in SPELLINGS:
        spelled = f"replace({spelled}, ' {variant} ', ' {usual} ')"
    known = ", ".join(f"({_text(licence)}, {_text(t)})" for licence, t in KNOWN)
    return rf"""
WITH texts AS (SELECT doc_id, NULL AS licence, text FROM documents
               UNION ALL SELECT NULL, licence, text FROM (VALUES {known}) AS k (licence, text)),
wide AS (SELECT doc_id, licence, '  ' || replace(regexp_replace(array_to_string(list_filter(
             string_split(lower(coalesce(text, '')), chr(10)), lambda x: NOT regexp_matches(x, {_text(COPYRIGHT)})), chr(10)),
             '{APART}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  ' AS wide FROM texts),
lines AS (SELECT doc_id, licence, list_transform(string_split({spelled}, chr(10)),
             lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))) AS lines FROM wide),
parts AS (SELECT *, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS whole,
             list_transform(regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+'),
                            lambda b: trim(replace(b, chr(10), ' '))) AS blocks FROM lines),
known AS (SELECT DISTINCT licence, whole FROM parts WHERE licence IS NOT NULL),
units AS (SELECT doc_id, whole, unnest(list_concat([whole], blocks, lines)) AS unit FROM parts WHERE licence IS NULL)
SELECT doc_id, known.licence, count(DISTINCT unit) AS n_units, max(unit = units.whole) AS entire
FROM units JOIN known ON unit = known.whole WHERE unit <> '' GROUP BY ALL
"""


@query("op8_licences", _licence_sql())
def op8(spark, d):
    return scan_licences(table(spark, d, "documents"))


@query("op11_packing")
def op11(spark, d):
    return packed_pieces(table(spark, d, "documents"), public_tokenizer())


@query("op12_alignment")
def op12(spark, d):
    return align_tokenizers(table(spark, d, "documents"), public_tokenizer(), public_tokenizer("piece_bpe_32k.model"))


@query("op13_conversation_trie", r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
               FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, conv_id - conv_id % 20 AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce(
            list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))
            AS state FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (SELECT conv_id, base, xor(state, 4294967295) % 4 AS h FROM crc),
heads AS (SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h),
seq AS (SELECT conv_id, 0 AS side, place, role, text FROM heads
        UNION ALL SELECT t.conv_id, 1, t.place, t.role, t.text FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE t.place >= c.h),
built AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY side, place) FILTER (role IS NOT NULL), []) AS s
          FROM convs c LEFT JOIN seq ON seq.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, len(s) AS length, unnest(range(0, len(s) + 1)) AS depth, s FROM built),
named AS (SELECT conv_id, depth, length, sha256(to_json(s[1:depth])::VARCHAR) AS node,
                 CASE WHEN depth > 0 THEN sha256(to_json(s[1:depth - 1])::VARCHAR) END AS parent,
                 CASE WHEN depth > 0 THEN len(regexp_extract_all(s[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM members),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 (count(*) - 1) * any_value(words) AS saved,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends FROM named GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
path AS (SELECT DISTINCT a.node AS top, b.node FROM named a JOIN named b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM path JOIN known USING (node) GROUP BY top)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN sums s ON s.top = k.node LEFT JOIN known p ON p.node = k.parent
""")
def op13(spark, d):
    return conversation_trie(table(spark, d, "conversations"))
