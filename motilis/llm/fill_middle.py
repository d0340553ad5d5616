"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and written in one of two orders, by DuckDB over Arrow batches.

Each batch of a task is registered with a DuckDB connection of its own and one SQL statement does the rest: sha256 of the
document's id draws the two cuts and the form, `regexp_extract_all` takes the text apart from left to right, `list_slice` and
`array_to_string` put the three parts together. A text is first taken apart into blocks of BLOCK code points; only the two
blocks that a cut falls into are taken apart into single ones, so that a list holds a BLOCKth of the text's length. No row
passes through Python, no row leaves its partition, and a repeated run gives the same cuts.

Forms: plain, the text as it stands; psm, `<P>` prefix `<S>` suffix `<M>` middle; spm, `<S>` suffix `<P>` prefix `<M>` middle.
A text that holds a marker stays plain, so that every output can be taken back; `restored` does.

Defined results: null text counts as empty, an empty text is plain with n = 0; a null doc_id draws as if its decimal form were
empty; equal doc_ids draw equal numbers, repeated rows give repeated rows; an empty table gives an empty result; whole texts are
cut, however long; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, load, pieces

BLOCK = 64
#: Shares in percent: texts that stay plain although they could be cut, and spm among those that are cut.
PLAIN, SPM = 10, 20
SEED = 1

_MACROS = f"""
CREATE MACRO units(s) AS regexp_extract_all(s, '(?s).');
CREATE MACRO joined(l, a, b) AS coalesce(array_to_string(list_slice(l, a, b), ''), '');
CREATE MACRO head(l, k) AS joined(l, 1, k // {BLOCK}) || joined(units(l[k // {BLOCK} + 1]), 1, k % {BLOCK});
CREATE MACRO tail(l, k) AS joined(units(l[k // {BLOCK} + 1]), k % {BLOCK} + 1, {BLOCK}) || joined(l, k // {BLOCK} + 2, len(l));
CREATE MACRO inside(l, a, b) AS CASE WHEN a // {BLOCK} = b // {BLOCK} THEN joined(units(l[a // {BLOCK} + 1]), a % {BLOCK} + 1, b % {BLOCK})
  ELSE joined(units(l[a // {BLOCK} + 1]), a % {BLOCK} + 1, {BLOCK}) || joined(l, a // {BLOCK} + 2, b // {BLOCK}) || joined(units(l[b // {BLOCK} + 1]), 1, b % {BLOCK}) END;
CREATE MACRO part(h, k) AS CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT);
CREATE MACRO after(s, mark) AS substr(s, instr(s, mark) + 3);
CREATE MACRO before(s, mark) AS substr(s, 1, instr(s, mark) - 1);
"""


def _cut_sql(seed: int, plain: int, spm: int) -> str:
    return f"""
WITH drawn AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
), shaped AS (
  SELECT doc_id, text, n, least(part(h, 1) % (n + 1), part(h, 2) % (n + 1)) AS a, greatest(part(h, 1) % (n + 1), part(h, 2) % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR part(h, 3) % 100 >= {100 - plain} THEN 'plain'
         WHEN part(h, 4) % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), apart AS (
  SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') END AS l FROM shaped
), told AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || head(l, a) || '<S>' || tail(l, b) || '<M>' || inside(l, a, b)
              ELSE '<S>' || tail(l, b) || '<P>' || head(l, a) || '<M>' || inside(l, a, b) END AS output
  FROM apart
)"""


_RESTORED = """CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN before(substr(output, 4), '<S>') || after(output, '<M>') || before(after(output, '<S>'), '<M>')
  ELSE before(after(output, '<P>'), '<M>') || after(output, '<M>') || before(substr(output, 4), '<P>') END"""


def _in_duckdb(sql: str, schema: pa.Schema) -> Callable:
    """A function for mapInArrow: the statement over each batch, which it sees as the table `batch`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as db:
            db.execute(_MACROS)
            for batch in batches:
                for piece in pieces(batch, "output" if "output" in batch.schema.names else "text"):
                    db.register("batch", pa.Table.from_batches([piece]))
                    yield from db.sql(sql).to_arrow_table().cast(schema).to_batches()
                    db.unregister("batch")

    return run


_KEYS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def fill_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain) and output, the text in its form."""
    sql = _cut_sql(seed, plain, spm) + " SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM told"
    return id_text(docs).mapInArrow(_in_duckdb(sql, pa.schema([*_KEYS, ("output", pa.string())])), f"{_DDL}, output string")


def restored(rows: DataFrame) -> DataFrame:
    """doc_id and text of rows with doc_id, form and output: the exact text again."""
    sql = f"SELECT doc_id, {_RESTORED} AS text FROM batch"
    return rows.select("doc_id", "form", "output").mapInArrow(_in_duckdb(sql, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])), "doc_id long, text string")


def digests(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """As fill_middle, with sha256 of the output and of the text that it is taken back to in place of the output."""
    sql = _cut_sql(seed, plain, spm) + f" SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({_RESTORED}) AS restored_sha256 FROM told"
    schema = pa.schema([*_KEYS, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    return id_text(docs).mapInArrow(_in_duckdb(sql, schema), f"{_DDL}, output_sha256 string, restored_sha256 string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT *, CAST(['0x' || substr(h, 1, 8), '0x' || substr(h, 9, 8), '0x' || substr(h, 17, 8), '0x' || substr(h, 25, 8)] AS BIGINT[]) AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN concat('<P>', substring(t, 1, a), '<S>', substring(t, b + 1), '<M>', substring(t, a + 1, b - a))
    ELSE concat('<S>', substring(t, b + 1), '<P>', substring(t, 1, a), '<M>', substring(t, a + 1, b - a)) END AS output FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
