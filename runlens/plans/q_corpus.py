"""Driver queries for the source corpus (Q5: S7, P2, F27, A7).

Bridge B7: each document is a source file of repository ``source``:
``src/main/d{doc_id}{ext}`` with ext by doc_id % 5 -> .java .py .JAVA .txt .sql;
under ``.git/objects/`` when doc_id % 13 = 0; a hidden file (leading '.') when
doc_id % 17 = 0; content = UTF-8 text, plus a 0xFF byte (not UTF-8) when
doc_id % 19 = 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import corpus as CO
from runlens.plans import bridges as B
from runlens.plans.catalog import register

_EXTS = [".java", ".py", ".JAVA", ".txt", ".sql"]


def b7_source_files(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (i % 5 + 1).cast("int"))
    name = F.concat(F.when(i % 17 == 0, F.lit(".")).otherwise(F.lit("")), F.lit("d"), i.cast("string"), ext)
    rel = F.concat(F.when(i % 13 == 0, F.lit(".git/objects/")).otherwise(F.lit("src/main/")), name)
    content = F.when(i % 19 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(
        F.encode("text", "UTF-8"))
    return d.select(F.col("source").alias("repo"), rel.alias("rel_path"),
                    F.concat(F.lit("/repos/"), F.col("source"), F.lit("/"), rel).alias("path"),
                    content.alias("content"))


def _files_written(spark, sf_dir):
    """Every document as a file ``_d{doc_id}.py``, sixteen to a folder ``pkg{n}`` (n = doc_id div 16) of repository
    ``r{n % 50}``, with an empty ``__init__.py`` in each folder and beside it a hidden copy that no corpus holds."""
    import uuid

    from runlens.session import checkpoint_dir, ship_package
    from runlens.sources.tree import open_root
    ship_package(spark)
    root = f"{checkpoint_dir(spark).rstrip('/')}/runlens-io/tree-{uuid.uuid4().hex[:12]}"

    def write(batches):
        import pyarrow as pa
        system, base = open_root(root)
        made = set()
        for batch in batches:
            folders = set()
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, files = i // 16, [(f"pkg{i // 16}/_d{i}.py", text)]
                if n not in folders:
                    files += [(f"pkg{n}/__init__.py", ""), (f".hidden/h{n}.py", text)]
                    folders.add(n)
                for rel, data in files:
                    folder, _, name = f"{base}/r{n % 50}/{rel}".rpartition("/")
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    with system.open_output_stream(f"{folder}/{name}") as f:
                        f.write(data.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["files"])

    d = B.table(spark, sf_dir, "documents")
    d.select("doc_id", "text").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


@register("source_tree", oracle="""
WITH f AS (SELECT doc_id // 16 AS n, max(text) AS text FROM documents GROUP BY doc_id // 16)
SELECT 'r' || CAST(n % 50 AS VARCHAR) AS repo, 'pkg' || CAST(n AS VARCHAR) || '/_d' || CAST(n AS VARCHAR) || '.py' AS rel_path,
       md5(text) AS content_md5, CAST(strlen(text) AS BIGINT) AS content_bytes FROM f
UNION ALL
SELECT 'r' || CAST(n % 50 AS VARCHAR), 'pkg' || CAST(n AS VARCHAR) || '/__init__.py', md5(''), CAST(0 AS BIGINT) FROM f""")
def q_source_tree(spark, sf_dir):
    """A tree written to the shared folder and scanned: names with ``_`` and empty files stay, hidden paths go.

    Every document is written and scanned as a file of its own.  The SQL twin has one row per folder for them, the
    largest text under the folder's number, so the scanned files are brought to that form after the scan.  Writes its
    files at the time of the call.
    """
    from runlens.sources import files as S
    tree = S.scan_source_tree(spark, _files_written(spark, sf_dir), extensions=CO.DEFAULT_EXTENSIONS)
    named = F.regexp_replace("rel_path", "^pkg(\\d+)/_d\\d+\\.py$", "pkg$1/_d$1.py")
    tree = tree.groupBy("repo", named.alias("rel_path")).agg(F.max("content").alias("content"))
    return tree.select("repo", "rel_path", F.md5("content").alias("content_md5"), F.octet_length("content").cast("bigint").alias("content_bytes"))


@register("source_tree_files", oracle="""
SELECT 'r' || CAST(doc_id // 16 % 50 AS VARCHAR) AS repo, 'pkg' || CAST(doc_id // 16 AS VARCHAR) || '/_d' || CAST(doc_id AS VARCHAR) || '.py' AS rel_path,
       md5(text) AS content_md5, CAST(strlen(text) AS BIGINT) AS content_bytes FROM documents
UNION ALL
SELECT DISTINCT 'r' || CAST(doc_id // 16 % 50 AS VARCHAR), 'pkg' || CAST(doc_id // 16 AS VARCHAR) || '/__init__.py', md5(''), CAST(0 AS BIGINT) FROM documents""")
def q_source_tree_files(spark, sf_dir):
    """Every scanned file of the tree of ``source_tree``, one row each.  Writes its files at the time of the call."""
    from runlens.sources import files as S
    tree = S.scan_source_tree(spark, _files_written(spark, sf_dir), extensions=CO.DEFAULT_EXTENSIONS)
    return tree.select("repo", "rel_path", F.md5("content").alias("content_md5"), F.octet_length("content").cast("bigint").alias("content_bytes"))


_KEPT_SQL = """
  SELECT source AS repo, '/repos/' || source || '/src/main/d' || CAST(doc_id AS VARCHAR) ||
           ['.java', '.py', '.JAVA', '.txt', '.sql'][doc_id % 5 + 1] AS path, text
  FROM documents
  WHERE doc_id % 5 IN (0, 1, 4) AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0"""
_PIECES_SQL = f"""
  SELECT repo, path, chr(10) || '--- File: ' || path || ' ---' || chr(10) || text AS piece FROM ({_KEPT_SQL})"""


@register("corpus_layout", oracle=f"""
SELECT repo, path,
       CAST(COALESCE(SUM(length(piece) + 1) OVER (PARTITION BY repo ORDER BY path
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
       CAST(length(piece) AS BIGINT) AS piece_chars, piece
FROM ({_PIECES_SQL})""")
def q_corpus_layout(spark, sf_dir):
    """Q5: kept files in pack order with their offset in the repository's packed corpus."""
    return CO.corpus_layout(CO.corpus_pieces(b7_source_files(spark, sf_dir)))


@register("corpus_tree", oracle="""
WITH f AS (
  SELECT 'r' || CAST(doc_id // 16 % 50 AS VARCHAR) AS repo,
         '/repos/r' || CAST(doc_id // 16 % 50 AS VARCHAR) || '/src/d' || CAST(doc_id AS VARCHAR) || '.py' AS path, COALESCE(text, '') AS text
  FROM documents WHERE doc_id % 19 <> 0),
p AS (SELECT repo, path, chr(10) || '--- File: ' || path || ' ---' || chr(10) || text AS piece FROM f)
SELECT repo, path,
       CAST(COALESCE(SUM(length(piece) + 1) OVER (PARTITION BY repo ORDER BY path
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(length(piece) AS BIGINT) AS file_chars, md5(piece) AS file_md5
FROM p""")
def q_corpus_tree(spark, sf_dir):
    """Q5 from files: every document written as a source file, laid out from splits of 16 KB (many texts are longer); pieces brought together per file.

    A byte that is no UTF-8 stands at the end of the file when doc_id % 38 = 0 and at its start when
    doc_id % 38 = 19.  Offsets of a file's pieces must follow each other: a gap would show in ``offset``,
    which is each piece's place less the characters before it.  Writes its files at the time of the call.
    """
    i, text, bad = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FF"))
    content = F.when(i % 38 == 0, F.concat(text, bad)).when(i % 38 == 19, F.concat(bad, text)).otherwise(text)
    rel = F.format_string("r%d/src/d%d.py", F.expr("doc_id div 16 % 50"), i)
    # Written by the tasks that read the table: the files are the only copy of the texts.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = B.files_written(docs.select(rel.alias("rel"), content.alias("content")), "corpus")
    split = 16 << 10
    pieces = CO.corpus_tree_layout(spark, root, shown_root="/repos", split_bytes=split)
    # A piece shorter than a split is a whole file and gives its digest at once; only the others are brought together.
    whole = (F.col("start") == 0) & (F.octet_length("piece") < split)
    told = pieces.select("repo", "path", "start", "offset", "piece_chars", F.when(whole, F.md5("piece")).alias("md5"),
                         F.when(~whole, F.col("piece")).alias("piece"))
    files = told.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct("start", "offset", "piece_chars", "md5", "piece"))).alias("p"))
    before = F.aggregate("p", F.struct(F.lit(0).cast("bigint").alias("chars"), F.col("p")[0]["offset"].alias("at")),
                         lambda acc, x: F.struct((acc["chars"] + x["piece_chars"]).alias("chars"),
                                                 F.when(x["offset"] - acc["chars"] == acc["at"], acc["at"]).alias("at")))
    return files.select("repo", "path", before["at"].alias("offset"), before["chars"].alias("file_chars"),
                        F.coalesce(F.col("p")[0]["md5"], F.md5(F.array_join(F.transform("p", lambda x: x["piece"]), ""))).alias("file_md5"))


@register("corpus_summary", oracle=f"""
SELECT repo, CAST(COUNT(*) AS BIGINT) AS n_files, CAST(SUM(length(piece)) + COUNT(*) - 1 AS BIGINT) AS total_chars
FROM ({_PIECES_SQL}) GROUP BY repo""")
def q_corpus_summary(spark, sf_dir):
    """Q5 summary: files and packed length per repository."""
    return CO.corpus_summary(CO.corpus_pieces(b7_source_files(spark, sf_dir)))


@register("corpus_written", oracle=f"""
SELECT repo, CAST(COUNT(*) AS BIGINT) AS n_files, CAST(SUM(length(piece)) + COUNT(*) - 1 AS BIGINT) AS total_chars
FROM ({_PIECES_SQL}) GROUP BY repo""")
def q_corpus_written(spark, sf_dir):
    """A7 sink round trip: corpora written per repository as ordered part files, read back and measured.

    The part files are read as lines; lengths and header lines are summed per
    repository (partial aggregation), minus the one trailing line break the
    text writer adds after the last piece.  Writes at the time of the call.
    """
    import uuid
    from runlens.session import checkpoint_dir
    out = f"{checkpoint_dir(spark).rstrip('/')}/runlens-io/corpus-{uuid.uuid4().hex[:12]}"
    CO.write_corpus(CO.corpus_pieces(b7_source_files(spark, sf_dir)), out)
    # Read as lines, which split a large part file: a line break more than each line's length.
    lines = spark.read.option("lineSep", "\n").text(out)
    agg = lines.groupBy("repo").agg(F.sum(F.col("value").rlike("^--- File: ").cast("bigint")).alias("n_files"),
                                    F.sum(F.length("value") + 1).alias("chars"))
    return agg.select("repo", F.col("n_files").cast("bigint").alias("n_files"),
                      (F.col("chars") - 1).cast("bigint").alias("total_chars"))
