"""Whole jobs: folder of review files to reports, vectors and answers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.fixed import SERVICE_K
from reviewmill.operators.dedup import surviving_ordinals
from reviewmill.operators.embed import Embedder, HashingEmbedder
from reviewmill.operators.enrich import enrich_left_join
from reviewmill.operators.numbering import number_rows
from reviewmill.operators.vector_table import VectorTable, append_chunks
from reviewmill.plans import evaluate, index, reports, standardize
from reviewmill.sizes import spread
from reviewmill.sources import files, sinks

LOSS_COLUMNS = ["review_date", "rating_raw", "total_spent", "tip_amount", "tip_percentage"]


@dataclass
class EtlPaths:
    """Output folders of one run."""

    root: str

    def __getattr__(self, name: str) -> str:
        return os.path.join(self.root, name)


def run_etl(
    spark: SparkSession,
    raw_folder: str,
    out: str,
    metadata: str | None = None,
    run_id: str = "",
    at: str = "",
    by: str = "file",
    multi_line: bool | str = "auto",
    after_renumber: bool = False,
    null_text: str = "collapse",
    write_csv: bool = True,
    **coercion,
) -> EtlPaths:
    """Files to processed reviews and reports.

    The raw text is parsed once into a staged table; everything else reads the columns it needs
    from there. Dedup and numbering work on narrow rows, and full rows are shuffled once, when
    the numbers join them. A run without ``run_id`` or ``at`` gets a new id and the present time.
    """
    paths = EtlPaths(out)
    found = files.list_sources(spark, raw_folder, by)
    info_name = os.path.basename(metadata) if metadata else None
    resolved = files.resolve_sources(spark, [s for s in found if s.name != info_name])

    # keep empty rows, flagged, so that raw counts are whole
    mapped = files.scan_reviews(spark, resolved, multi_line, drop_empty=False)
    sinks.write_parquet(mapped, paths.staged)
    staged = spark.read.parquet(paths.staged)
    present = staged.filter("has_content")

    facts = standardize.source_facts(present, coercion.get("date_mode", "source"))
    typed = standardize.coerce_types(standardize.apply_facts(present, facts), **coercion)
    ready = standardize.extend(standardize.derive(typed))
    # File ordinals rise over all files, so no leading column is needed.
    survivors = surviving_ordinals(typed, null_text=null_text)
    numbers = number_rows(survivors, [], "ord", "row_id").select("ord", "row_id")
    processed = standardize.final_projection(ready, extended=True, keep=["ord"])
    sinks.write_per_source(processed.join(numbers, "ord"), paths.per_source)
    # sources of an earlier run into this folder are not part of this one
    ours = staged.select("source_file").distinct()
    kept = spark.read.parquet(paths.per_source).join(ours, "source_file", "left_semi")

    final = kept.withColumn("review_id", F.col("row_id"))
    core = standardize.final_projection(
        final.withColumn("review_id", F.col("row_id").cast("string"))
    ).withColumn("review_id", F.col("review_id").cast("long"))
    info = None
    if metadata is not None:
        info = files.scan_metadata(spark, metadata)
        core = enrich_left_join(core, info)
    sinks.write_parquet(core, paths.final)
    if write_csv:
        sinks.write_csv(spark.read.parquet(paths.final), paths.final_csv)
    sinks.write_snapshot(final, paths.snapshot)

    checked = final if after_renumber else kept
    statuses = reports.source_status(
        reports.validation_checks(checked.drop("review_length"), staged)
    )
    sinks.write_parquet(statuses, paths.validation)
    statuses = spark.read.parquet(paths.validation)
    meta = reports.validate_metadata(info, os.path.basename(metadata)) if metadata else None
    sinks.write_report(statuses, paths.validation_json)
    run_id, at = run_id or uuid.uuid4().hex, at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    sinks.write_report(reports.combined_status(statuses, meta, run_id, at), paths.status_json)
    sinks.write_report(
        reports.validation_document(statuses, staged, checked, meta, run_id, at), paths.document_json
    )
    sinks.write_report(reports.unmapped_categories(checked), paths.unmapped_json)
    sinks.write_report(
        reports.run_summary(statuses, reports.missing_thresholds(checked)), paths.summary_json
    )
    sinks.write_report(reports.value_counts(kept), paths.bias_json)
    sinks.write_report(files.file_report(spark, resolved), paths.files_json)
    sinks.write_report(files.schema_audit(spark, resolved), paths.audit_json)
    sinks.write_report(reports.categorical_report(typed), paths.categories_json)
    sinks.write_report(reports.coercion_loss(present, typed, LOSS_COLUMNS), paths.loss_json)
    core_columns = [c for c in kept.columns if c not in ("ord", "row_id")]
    sinks.write_report(reports.missingness(kept, core_columns), paths.missing_json)
    sinks.write_report(reports.by_restaurant(kept), paths.restaurants_json)
    sinks.write_report(reports.integrity_totals(kept), paths.integrity_json)
    raw_parts = files.scan_raw(spark, resolved, multi_line)
    for i, frame in enumerate(raw_parts):
        sinks.write_report(reports.integrity_totals(frame), f"{paths.raw_integrity_json}/{i:05d}")
        sinks.write_report(
            reports.missingness(frame.drop("ord")), f"{paths.raw_missing_json}/{i:05d}"
        )
    return paths


def run_row_index(
    spark: SparkSession, processed: DataFrame, table_path: str, version: int,
    embedder: Embedder | None = None,
) -> dict[str, int]:
    """Processed reviews into the keyed vector table; returns what became of the rows.

    Of several reviews with one id the later counts: by ``ord`` if there is one, else by its place
    in the input. Reviews without text or with a broken rating are left out before that.
    """
    embedder = embedder or HashingEmbedder()
    if "ord" not in processed.columns:
        processed = processed.withColumn("ord", F.monotonically_increasing_id())
    docs = spread(index.embed_projection(processed, keep=["ord"]), "review_id")
    return VectorTable(spark, table_path, dim=embedder.dim).upsert(
        docs, version, seq="ord", embedder=embedder
    )


def run_chunk_index(
    processed: DataFrame, path: str, embedder: Embedder | None = None
) -> dict[str, int]:
    """Processed reviews to chunk documents, appended; returns indexed and failed counts."""
    rows = spread(index.filter_nonempty_text(processed), "review_id")
    docs = index.chunk_projection(rows)
    return append_chunks(
        index.embed_documents(docs, embedder or HashingEmbedder(), "chunk_text"), path
    )


def run_search(
    questions: DataFrame, table_path: str, out: str, k: int = SERVICE_K,
    filters: Mapping[str, object] | None = None, embedder: Embedder | None = None,
) -> DataFrame:
    """The k best stored reviews of every question, with score and all stored fields; written and returned.

    ``filters`` limits the reviews before the k are chosen.
    """
    embedder = embedder or HashingEmbedder()
    spark = questions.sparkSession
    table = VectorTable(spark, table_path, dim=embedder.dim)
    stored = table.read()
    fields = [c for c in stored.columns if c not in ("vector", table.key)]
    hits = evaluate.search(questions, stored, embedder, k=k, key=table.key, keep=fields, filters=filters)
    hits.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def run_evaluate(
    gold: DataFrame, table_path: str, out: str, k: int = SERVICE_K, embedder: Embedder | None = None,
) -> DataFrame:
    """Answer the questions of ``gold`` (question, keywords) from the stored reviews and score the answers.

    Hits, answers with their scores, and the summary are written below ``out``; the summary is returned.
    A log of answers with latencies is scored by ``evaluate.run_eval``; here ``p95_ms`` is null.
    """
    embedder = embedder or HashingEmbedder()
    asked = gold.select("question").distinct()
    hits = run_search(asked, table_path, f"{out}/hits", k, embedder=embedder)
    answers = evaluate.answer_log(asked, hits)
    scored = evaluate.score_semantic(evaluate.score_keywords(answers, gold), gold, embedder)
    scored.write.mode("overwrite").parquet(f"{out}/answers")
    kept = gold.sparkSession.read.parquet(f"{out}/answers")
    summary = evaluate.eval_summary(kept, None)
    sinks.write_report(summary, f"{out}/summary")
    return summary
