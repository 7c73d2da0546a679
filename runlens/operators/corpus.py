"""Source corpus per repository (S7, P2, F27, A7 -> Q5).

The reference joins a repository's code files into one text.  Packing a
repository into one string would put the whole repository into one task, so
the corpus is produced in a layout that any repository size survives:

* ``corpus_pieces``: one row per kept file, ``\\n--- File: {path} ---\\n{text}``
  (map-only; files that are not valid UTF-8 are dropped, as the reference
  drops unreadable files);
* ``corpus_layout``: the character ``offset`` of each piece in the packed text
  (pieces in path order joined by '\\n').  The running sum works on range
  partitions, so a repository holding a third of all files is spread over many
  tasks instead of one window partition;
* ``corpus_tree_layout``: the same layout straight from a folder tree, for files
  of any length: a file is read in splits by as many tasks, and no text is
  shuffled or stored to find the offsets;
* ``write_corpus``: writes the packed text per repository as ordered text
  files (``partitionBy(repo)``; concatenating a repository's part files in
  name order gives the corpus plus one trailing newline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import FILE_HEADER_PREFIX, FILE_HEADER_SUFFIX, file_with_header

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Default code-file extensions (matched case-sensitively at the end of the name):
DEFAULT_EXTENSIONS = [".py", ".js", ".java", ".c", ".cpp", ".cs", ".go", ".rb", ".php", ".html", ".css", ".sql"]
# ---------------------------------------------------------------------------


def code_file_filter(rel_path, extensions=None):
    """No hidden directory on the repo-relative path, no hidden file, allowed extension."""
    import re
    exts = DEFAULT_EXTENSIONS if extensions is None else list(extensions)
    c = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    hidden = c.rlike("(^|/)\\.")
    alt = "|".join(re.escape(e) for e in exts)
    return ~hidden & c.rlike(f"({alt})$")


def corpus_pieces(files: DataFrame, repo_col: str = "repo", rel_col: str = "rel_path",
                  path_col: str = "path", content_col: str = "content", extensions=None) -> DataFrame:
    """P2 + F27 per file: (repo, path, piece) for kept files with readable text."""
    kept = files.filter(code_file_filter(rel_col, extensions))
    piece = file_with_header(F.col(path_col), F.col(content_col))
    return kept.select(repo_col, path_col, piece.alias("piece")).filter(F.col("piece") != "")


def corpus_layout(pieces: DataFrame, repo_col: str = "repo", path_col: str = "path",
                  n_ranges: int | None = None) -> DataFrame:
    """A7 layout: each piece's start ``offset`` in its repository's packed corpus.

    The offset is the running sum of the preceding pieces' lengths (+1 for the
    joining '\\n') in path order, computed by ``ranged_sum``: the pieces move
    once, into ranges, so a repository holding a third of all files is spread
    over many tasks instead of one window partition, and no text passes through
    Python workers.
    """
    from runlens.operators._plan import ranged_sum
    sized = pieces.withColumn("_len", F.length("piece").cast("bigint") + 1)
    out = ranged_sum(sized, [repo_col], [path_col], "_len", "offset", n_ranges=n_ranges)
    return out.select(repo_col, path_col, "offset", F.length("piece").cast("bigint").alias("piece_chars"), "piece")


#: Bytes of a file that one task holds as text at a time.
CORPUS_SPLIT = 16 << 20


def corpus_tree_layout(spark: SparkSession, root: str, extensions=None, shown_root: str | None = None,
                       split_bytes: int = CORPUS_SPLIT, n_ranges: int | None = None) -> DataFrame:
    """S7 + P2 + F27 + A7: (repo, path, start, offset, piece_chars, piece) of the tree ``root/<repo>/...``.

    Each file is cut into splits of ``split_bytes`` whose ends are moved to characters.  A first pass tells
    every split's code points and whether its bytes are UTF-8; one bad split drops its file, as a whole
    file that cannot be read is dropped.  Offsets are a running sum over these short rows, by
    (path, start), so neither a huge file nor a huge repository is one task's, and the texts are read only
    for the result.  ``piece`` is a split's text, behind the file's header in its first split
    (``start`` = 0, the split's byte place); the pieces of a repository by ``offset``, with a line feed
    between files, are its packed corpus.  Headers name ``shown_root`` (``root`` unless given).

    An empty file is its header, an empty tree gives no rows.  Files must not change between the passes.
    Runs jobs at the time of the call.
    """
    from runlens.operators._plan import running_sum
    from runlens.session import materialize
    from runlens.sources.files import list_source_tree
    from runlens.sources.tree import file_splits, split_chars, split_texts

    path = F.concat(F.lit((shown_root or root).rstrip("/") + "/"), F.col("rel"))
    files = list_source_tree(spark, root, DEFAULT_EXTENSIONS if extensions is None else extensions)
    measured = materialize(split_chars(file_splits(files, split_bytes).select("repo", "rel", "start"), root, split_bytes), "corpus-splits")
    unreadable = measured.where(F.col("chars").isNull()).select("rel").distinct()
    head = F.concat(F.lit(FILE_HEADER_PREFIX), F.col("path"), F.lit(FILE_HEADER_SUFFIX))
    first = F.col("start") == 0
    # The line feed between files is counted with a file's first split.
    sized = (measured.join(unreadable, "rel", "left_anti").withColumn("path", path)
             .withColumn("_len", F.col("chars") + F.when(first, F.length(head) + 1).otherwise(0)))
    placed = running_sum(sized, ["repo"], ["path", "start"], "_len", "_sum", n_ranges=n_ranges)
    laid = placed.select("repo", "path", "rel", "start", (F.col("_sum") - F.when(first, 0).otherwise(1)).alias("offset"),
                         (F.col("_len") - F.when(first, 1).otherwise(0)).alias("piece_chars"))
    piece = F.concat(F.when(first, head).otherwise(F.lit("")), F.col("text"))
    return split_texts(laid, root, split_bytes).select("repo", "path", "start", "offset", "piece_chars", piece.alias("piece"))


def corpus_summary(pieces: DataFrame, repo_col: str = "repo") -> DataFrame:
    """Per repository: number of files and length of the packed corpus (partial aggregation)."""
    return pieces.groupBy(repo_col).agg(
        F.count(F.lit(1)).alias("n_files"),
        (F.sum(F.length("piece")) + F.count(F.lit(1)) - 1).cast("bigint").alias("total_chars"))


def write_corpus(pieces: DataFrame, out_dir: str, repo_col: str = "repo", path_col: str = "path",
                 n_ranges: int | None = None) -> None:
    """Write each repository's packed corpus as ordered text part files (no driver round trip).

    The number of ranges follows the input's size unless given.  Repositories that are written replace
    their stored corpora; others stay.
    """
    from runlens.operators._plan import ranges_for
    (pieces.repartitionByRange(ranges_for(pieces, n_ranges), repo_col, path_col)
           .sortWithinPartitions(repo_col, path_col)
           .select(repo_col, "piece")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(repo_col).text(out_dir))
