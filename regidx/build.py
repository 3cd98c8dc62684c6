"""Index build job: landing files to chunks, vectors, index table, cells and statistics.

    spark-submit ... regidx/build.py --landing DIR --table DIR [--only bacen ...]
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regidx.fixed import SOURCES, VECTOR_CELLS
from regidx.operators.cells import refresh_statistics, train_centroids, write_cells
from regidx.operators.embedding import EncoderFactory, add_embedding, sentence_model
from regidx.plans.chunks import build_chunks
from regidx.plans.index_table import IndexTable
from regidx.session import build_session, scratch_path
from regidx.sources.chunk_files import load_chunks, save_chunks

log = logging.getLogger(__name__)


@dataclass
class BuildReport:
    indexed: int = 0
    rows_read: dict[str, int] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    stats: DataFrame | None = None


def build_index(
    spark: SparkSession, landing: str, table: IndexTable, *, limit: int | None = None,
    only: list[str] | None = None, reset: bool = False, encoder: EncoderFactory | None = None,
    chunk_path: str | None = None, cell_path: str | None = None, cells: int = VECTOR_CELLS,
) -> BuildReport:
    """Run the whole job; chunks are stored before encoding, so a retry never re-reads the files."""
    chunks, run = build_chunks(spark, landing, limit, only)
    stored = load_chunks(spark, save_chunks(chunks, chunk_path or scratch_path(spark, "chunks")))
    report = BuildReport(rows_read=run.rows_read(), failures=run.failures)
    if stored.isEmpty():
        log.error("no chunk produced from %s", landing)
        return report
    table.create()
    embedded = add_embedding(stored, "embed_text", encoder)
    if reset:
        table.truncate()
    if only and not reset:
        report.indexed = table.replace_sources(embedded, only)
    else:
        report.indexed = table.upsert(embedded)
    index = table.read()
    if cell_path:
        centroids = train_centroids(index, cells)
        refresh_statistics(spark, write_cells(index, centroids, cell_path), centroids)
    width = index.select(F.size("embedding")).first()[0]
    report.stats = table.statistics(dimension=width)
    return report


def main() -> int:
    parser = argparse.ArgumentParser(description="Build the company index")
    parser.add_argument("--landing", required=True)
    parser.add_argument("--table", required=True)
    parser.add_argument("--buckets", type=int, default=64)
    parser.add_argument("--limit", type=int, default=None, help="rows per source; 0 or absent = all")
    parser.add_argument("--only", nargs="+", choices=SOURCES)
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--cells", help="folder for the clustered copy")
    parser.add_argument("--model", help="sentence-transformers model name")
    args = parser.parse_args()
    spark = build_session("regidx-build")
    report = build_index(
        spark, args.landing, IndexTable(spark, args.table, args.buckets), limit=args.limit, only=args.only,
        reset=args.reset, encoder=sentence_model(args.model) if args.model else None, cell_path=args.cells,
    )
    log.info("rows read %s, failures %s, indexed %d", report.rows_read, report.failures, report.indexed)
    if report.stats is None:
        return 1
    report.stats.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
