"""Inputs for the queries: driver tables seen as files of a code corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents as files of plain text; the same SQL for both engines.
TEXT_FILES = """SELECT concat('src/m', doc_id % 20, '/doc_', doc_id, '.md') AS path, 'markdown' AS lang, text AS content, '' AS symbols FROM documents"""

#: A synthetic corpus of scripts: two imports and a function before each text, twins that make imports ambiguous, and tests.
CODE_FILES = """
SELECT concat('src/m', doc_id % 20, '/doc_', doc_id, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.tsx' END) AS path,
       CASE doc_id % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS lang,
       concat('import a from ''./doc_', doc_id + 20, '''', chr(10), 'import b from ''../m', (doc_id + 7) % 20, '/doc_', doc_id + 7, '''', chr(10),
              'export function f_', doc_id, '() {}', chr(10), text) AS content
FROM documents
UNION ALL
SELECT concat('src/m', doc_id % 20, '/doc_', doc_id, '/index.ts'), 'typescript', concat('export class Twin_', doc_id, ' {}', chr(10)) FROM documents WHERE doc_id % 50 = 0
UNION ALL
SELECT concat('src/m', doc_id % 20, '/tests/t_', doc_id, '.ts'), 'typescript', concat('import t from ''../doc_', doc_id, '''', chr(10), 'export function test_', doc_id, '() {}', chr(10)) FROM documents WHERE doc_id % 10 = 3
"""

#: Each document as two Python files: one that parses, with the text as comments, and one of plain text, for which the parser gives up.
PYTHON_FILES = r"""
SELECT concat('py/m', doc_id % 20, '/doc_', doc_id, '.py') AS path, 'python' AS lang,
       concat('import os, m', (doc_id + 7) % 20, '.doc_', doc_id + 7, ' as n\nfrom .doc_', doc_id + 20, ' import (\n  f)\nfrom __future__ import annotations\n@deco\nclass K_', doc_id,
              ':\n    async def m(self):\n        pass\n\ndef f_', doc_id, '():\n    return 1\n# ', regexp_replace(replace(text, char(0), ' '), '[\n\r]', '\n# '), '\n') AS content
FROM documents
UNION ALL
SELECT concat('py/raw/doc_', doc_id, '.py'), 'python', concat('def broken_', doc_id, '(:\nimport m', doc_id % 20, '.doc_', doc_id, '\n', text) FROM documents
"""

#: Each document as a Rust file, with the text as comments.
RUST_FILES = r"""
SELECT concat('rs/src/m', doc_id % 20, '/doc_', doc_id, '.rs') AS path, 'rust' AS lang,
       concat('use crate::m', (doc_id + 7) % 20, '::doc_', doc_id + 7, '::A;\nuse super::doc_', doc_id + 20, '::{A, B};\nuse std::fs;\nmod inner;\npub struct A_', doc_id,
              ' { x: i32 }\nimpl<T> Show for A_', doc_id, ' {\n    fn go(&self) -> &\'static str { "}" }\n}\n// ', regexp_replace(text, '\n', '\n// '), '\n') AS content
FROM documents
"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the documents table of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return over(text, "documents", docs)


def over(text: str, name: str, rows: DataFrame) -> DataFrame:
    """The SQL `text` with the table `name` standing for `rows`."""
    plain = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return rows.sparkSession.sql(plain, **{name: rows})


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TEXT_FILES)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CODE_FILES).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PYTHON_FILES)


def rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RUST_FILES)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same rows as SQL, for the other engine."""

    def say(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "[" + ", ".join(map(say, v)) + "]" if isinstance(v, (list, tuple)) else "'" + str(v).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) AS v({names}))"
