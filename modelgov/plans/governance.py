"""The whole run: definition folders in, decisions, statements, lineage and edited text out.

Each stage is a relation.  Relations that later stages read more than once are written to the
shared checkpoint folder; nothing passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import catalog, cleanup, decide, graph, layout, render, report, tom, usage
from ..operators import textparse as tp
from ..session import materialise, path_exists
from ..sources import containers, definitions
from ..sources.relations import read_catalog, read_relation, security_set, view_set

#: relations of an exported object model: needed ones, then those a model may lack
NEEDED_EXPORTS = ("tables", "columns", "measures", "relationships")
OTHER_EXPORTS = ("hierarchies", "levels", "variations", "partitions", "roles", "permissions", "annotations")
#: relations of a model that protect columns; written by ``run`` and read by ``decide_stored``
STRUCTURE = ("links", "owner_refs", "levels", "variations", "sort_by")


@dataclass
class Model:
    """Everything read from the definition text of a corpus of models."""

    files: DataFrame | None
    blocks: DataFrame | None
    formulas: DataFrame | None
    closure: DataFrame | None
    tables: DataFrame
    columns: DataFrame
    relations: DataFrame
    unresolved: DataFrame
    security: DataFrame
    links: DataFrame
    owner_refs: DataFrame
    levels: DataFrame
    variations: DataFrame
    sort_by: DataFrame


def read_models(files: DataFrame) -> Model:
    """``files``: (model_id, path, content) of all model definition files."""
    table_files = definitions.table_files(files)
    blocks = materialise(tp.blocks(table_files))
    formulas = materialise(tp.measure_formulas(blocks))
    tables = materialise(catalog.catalog_tables(tp.parse_tables(table_files)))
    columns = materialise(catalog.catalog_columns(tp.parse_columns(blocks), tp.parse_measures(blocks), tables))
    resolved = materialise(catalog.resolve_relations(tp.parse_relations(definitions.relationship_files(files)), tables, columns))
    return Model(
        files=table_files, blocks=blocks, formulas=formulas,
        closure=materialise(graph.measure_closure(formulas, tp.measure_refs(formulas))),
        tables=tables, columns=columns, relations=catalog.catalog_relations(resolved),
        unresolved=catalog.unresolved_relations(resolved),
        security=tp.security_tables(definitions.role_files(files)),
        links=tp.semantic_links(blocks), owner_refs=tp.formula_owner_refs(tp.dax_blocks(blocks)),
        levels=tp.hier_levels(blocks), variations=tp.variations(blocks), sort_by=tp.sort_by(blocks),
    )


def read_exports(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Exported object-model tables, one folder each under ``root`` -> definition files (model_id, path, content)."""
    found = {n for n in NEEDED_EXPORTS + OTHER_EXPORTS if path_exists(spark, f"{root}/{n}")}
    if missing := [n for n in NEEDED_EXPORTS if n not in found]:
        raise FileNotFoundError(f"the export {root} lacks {missing}")
    raw = {n: read_relation(spark, f"{root}/{n}", fmt).withColumn("model_id", F.col("model_id").cast("string")) for n in found}
    tables = materialise(tom.tom_tables(raw["tables"]))
    notes = tom.tom_annotations(raw["annotations"]) if "annotations" in found else None
    levels = "hierarchies" in found and "levels" in found
    parts = [
        render.table_file_parts(
            tables, tom.tom_measures(raw["measures"], tables), tom.tom_columns(raw["columns"], tables),
            tom.tom_hierarchies(raw["hierarchies"], raw["levels"], raw["columns"], tables) if levels else None,
            tom.tom_variations(raw["variations"], raw["columns"], raw["relationships"], raw["hierarchies"], raw["tables"])
            if levels and "variations" in found else None,
            tom.tom_partitions(raw["partitions"], tables) if "partitions" in found else None, notes,
        ),
        render.relation_parts(tom.tom_relations(raw["relationships"], raw["tables"], raw["columns"])),
        render.model_parts(tables),
    ]
    if "roles" in found and "permissions" in found:
        parts.append(render.role_parts(tom.tom_roles(raw["permissions"], raw["roles"], raw["tables"])))
    return render.assemble(render.union_parts(parts))


def models_by_name(model: Model, documents: DataFrame) -> DataFrame:
    """(report_id, model_id) of reports that share a model's name before the suffix."""
    names = model.tables.select("model_id").distinct().withColumn("stem", F.regexp_replace("model_id", r"\.[^.]*$", ""))
    reports = documents.select("report_id").distinct().withColumn("stem", F.regexp_replace("report_id", r"\.[^.]*$", ""))
    return reports.join(names, "stem").select("report_id", "model_id")


def unmatched_reports(documents: DataFrame, model_of: DataFrame) -> DataFrame:
    """Audit: reports without a model.  What they use is unknown to the decisions."""
    return documents.select("report_id").distinct().join(model_of, "report_id", "left_anti")


def unread_documents(documents: DataFrame) -> DataFrame:
    """Audit: documents whose content is no JSON.  What they use is unknown to the decisions."""
    unread = F.col("content").isNull() | F.try_parse_json("content").isNull()
    return documents.filter(unread).select("report_id", "page_id", "visual_id", "kind")


def read_usage(model: Model, documents: DataFrame, model_of: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """Usage rows of all reports, checked against the catalog; ``status`` tells what happened.

    ``documents``: (report_id, page_id, visual_id, kind, content).  ``model_of`` maps report_id
    to model_id; without it a report belongs to the model of the same name before the suffix.
    ``layouts``: (report_id, layout_json) of legacy reports.
    """
    if model_of is None:
        model_of = models_by_name(model, documents)
    docs = materialise(documents.join(model_of, "report_id"))
    pages = report.page_documents(docs.filter("kind = 'page'"))
    visuals = materialise(report.page_visuals(pages, report.visual_documents(docs.filter("kind = 'visual'"))))
    labelled = materialise(report.visual_labels(visuals))

    def expand(rows: DataFrame) -> DataFrame:
        return report.expand_measures(rows, model.formulas, model.closure)

    fields = materialise(expand(report.visual_fields(labelled)))
    parts = [
        expand(report.report_filters(docs.filter("kind = 'report'"))), expand(report.page_filters(pages)),
        fields, expand(report.visual_filters(labelled, fields)),
    ]
    if layouts is not None:
        # parsed once; bookmarks name no fields
        parsed = materialise(layout.layout_documents(layouts).withColumn("doc", F.col("doc").dropFields("bookmarks")))
        shown, above, of_visuals = layout.layout_uses(parsed, model_of)
        shown = materialise(expand(shown))
        seen = ["model_id", "report_id", "page_id", "visual_id", "table_name", "column_name"]
        parts += [shown, expand(above), expand(of_visuals.join(shown.select(*seen).distinct(), seen, "left_anti"))]
    return report.validate_refs(report.field_usage(parts), model.columns)


@dataclass
class Decisions:
    counts: DataFrame
    columns: DataFrame
    tables: DataFrame
    drop_tables: DataFrame
    drop_columns: DataFrame
    model_items: DataFrame
    conflicts: DataFrame
    unmatched_usage: DataFrame
    unmatched_endpoints: DataFrame


def decide_all(
    model: Model, uses: DataFrame, views: DataFrame | None = None, security: DataFrame | None = None,
    mode: str = "single_pass", schema: str = "dbo",
) -> Decisions:
    """Counts, flags, protections, roll-up and statements.

    ``uses``: rows of ``read_usage`` (dropped references are left out here).  ``mode``:
    single_pass protects in the fixed order once; fixpoint keeps all a kept column needs.
    """
    rows = usage.kept_uses(uses)
    counts = materialise(usage.field_usage_counts(usage.usage_classify(usage.usage_explode(usage.distinct_uses(rows)))))
    columns = model.columns.drop("table_name", "path")
    master = materialise(catalog.semantic_master(columns, model.tables))
    ends = materialise(catalog.relation_names(model.relations, model.tables, columns))
    flagged = decide.base_decisions(usage.used_in_relationship(usage.used_in_report(master, counts), ends))
    guarded = security_set(security, model.security)
    listed = materialise(decide.protect_lists(flagged, guarded, view_set(views) if views is not None else None))
    if mode == "fixpoint":
        edges = decide.dependency_edges(model.links, model.owner_refs, model.levels, model.variations, model.sort_by)
        final = decide.protect_fixpoint(listed, edges)
    elif mode == "single_pass":
        final = decide.protect_structure(listed, model.links, model.owner_refs, model.levels)
    else:
        raise ValueError(f"unknown protection mode {mode!r}")
    final = materialise(final)
    tables = materialise(decide.table_decisions(final, guarded))
    dropped = decide.drop_columns(final, tables, schema)
    return Decisions(
        counts=counts, columns=final, tables=tables, drop_tables=decide.drop_tables(tables, schema), drop_columns=dropped,
        model_items=decide.model_cleanup(final, tables),
        conflicts=decide.drop_conflicts(dropped, final, model.variations, model.levels, model.sort_by),
        unmatched_usage=usage.unmatched_usage(master, counts), unmatched_endpoints=usage.unmatched_endpoints(master, catalog.all_names(ends, model.unresolved)),
    )


def lineage(model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table lineage, measure lineage, summary)."""
    edges = materialise(graph.filter_edges(model.relations, model.tables))
    table = materialise(graph.filter_lineage(edges, model.tables))
    columns = model.columns.withColumn("kind", catalog.column_kind(F.col("source_column")))
    return table, graph.measure_lineage(table, columns), graph.lineage_summary(edges, table)


def clean_up(model: Model, decisions: Decisions, mode: str = "tmdl_only") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edited files, removed items, skipped items)."""
    cands = materialise(cleanup.candidates(decisions.columns, mode))
    reasons = cleanup.protection_reasons(
        cands, decisions.columns, model.links, model.owner_refs, model.levels, model.variations, model.sort_by
    )
    plan = materialise(cleanup.cleanup_plan(cands, reasons, model.blocks, model.tables))
    files, cascade = cleanup.cleanup_text(model.files, plan)
    return files, cleanup.removed_items(plan, cascade), cleanup.skipped_items(plan)


def input_errors(spark: SparkSession, roots: dict[str, str | None]) -> list[str]:
    """What is wrong with the given folders: missing ones, and kinds of input that none of them holds."""
    errors = [f"{name} not found: {root}" for name, root in roots.items() if root is not None and not path_exists(spark, root)]
    for kind, names in (("model", ("models_root", "export_root")), ("report", ("reports_root", "layouts_root"))):
        if all(roots[n] is None for n in names):
            errors.append(f"no {kind} given: pass {' or '.join(names)}")
    return errors


def content_errors(files: DataFrame, documents: DataFrame) -> list[str]:
    """What is wrong with the files found: each kind of fault with its count and up to three examples."""

    def told(text: str, rows: DataFrame) -> list[str]:
        some = [r[0] for r in rows.limit(3).collect()]
        return [f"{text}: {rows.count()}, such as {some}"] if some else []

    def without(rows: DataFrame, key: str, good: DataFrame) -> DataFrame:
        named = rows.filter(F.col(key) != "").select(key).distinct()
        return named.join(good.select(key).distinct(), key, "left_anti")

    return (
        told("model files outside a definition folder", files.filter("model_id = ''").select("path"))
        + told("report files outside a definition folder", documents.filter("report_id = ''").select("kind"))
        + told("models without a tables folder", without(files, "model_id", definitions.table_files(files)))
        + told("reports without pages", without(documents, "report_id", documents.filter("page_id IS NOT NULL")))
    )


def run(
    spark: SparkSession, models_root: str | None, reports_root: str | None, out: str, views: DataFrame | None = None,
    security: DataFrame | None = None, cleanup_mode: str | None = None, schema: str = "dbo",
    mode: str = "single_pass", model_of: DataFrame | None = None, on_unmatched: str = "raise",
    layouts_root: str | None = None, export_root: str | None = None,
) -> Decisions:
    """Read the corpora, decide, and write every result and audit under ``out``.

    Models are definition folders (``models_root``), exported object-model tables (``export_root``) or both;
    reports are definition folders (``reports_root``), legacy containers (``layouts_root``) or both.  All faults of
    the inputs are told at once.  ``model_of`` and ``mode`` are those of ``read_usage`` and ``decide_all``.  Reports
    without a model end the run (``on_unmatched="raise"``) or are only written to the audits (``"audit"``).
    A model with unread documents, layouts or relationships gets no DROP statements.  ``out/metrics`` holds the number
    of rows of every relation, observed while it was written.
    """
    if on_unmatched not in ("raise", "audit"):
        raise ValueError(f"unknown handling of unmatched reports {on_unmatched!r}")
    roots = {"models_root": models_root, "export_root": export_root, "reports_root": reports_root, "layouts_root": layouts_root}
    errors = input_errors(spark, roots)
    there = {n: r for n, r in roots.items() if r is not None and path_exists(spark, r)}
    files = spark.createDataFrame([], definitions.FILE_SCHEMA)
    documents = spark.createDataFrame([], "report_id string, page_id string, visual_id string, kind string, content string")
    if "models_root" in there:
        files = files.unionByName(definitions.scan_model_text(spark, models_root))
    if "export_root" in there:
        files = files.unionByName(read_exports(spark, export_root))
    if "reports_root" in there:
        documents = documents.unionByName(definitions.scan_reports(spark, reports_root))
    files, documents = materialise(files), materialise(documents)
    errors += content_errors(files, documents)
    if errors:
        raise FileNotFoundError("; ".join(errors))
    layouts = materialise(containers.report_layouts(containers.scan_layouts(spark, layouts_root))) if layouts_root else None
    model = read_models(files)
    named = documents.select("report_id") if layouts is None else documents.select("report_id").union(layouts.select("report_id"))
    model_of = materialise(models_by_name(model, named) if model_of is None else model_of)
    alone, unread = unmatched_reports(named, model_of), unread_documents(documents)
    if layouts is not None:
        absent = F.lit(None).cast("string")
        unread = unread.unionByName(containers.unread_layouts(layouts, "report_id").select(
            "report_id", absent.alias("page_id"), absent.alias("visual_id"), F.lit("layout").alias("kind")))
    unread = materialise(unread)
    unread_ends = materialise(tp.unread_relations(definitions.relationship_files(files)))
    counts: dict[str, int] = {}

    def keep(df: DataFrame, where: str) -> None:
        sinks.write_counted(df, f"{out}/{where}", counts, where)

    for name, audit in (
        ("unmatched_reports", alone), ("unread_documents", unread), ("unread_relations", unread_ends),
        ("unresolved_relations", model.unresolved), ("bad_semantic_links", tp.bad_semantic_links(model.blocks)),
    ):
        keep(audit, f"audit/{name}")
    lone = alone.limit(3).collect() if on_unmatched == "raise" else []
    if lone:
        raise ValueError(f"reports without a model, such as {[r[0] for r in lone]}: pass model_of, or on_unmatched='audit'")
    uses = materialise(read_usage(model, documents, model_of, layouts))
    keep(uses, "usage")
    sinks.write_catalog(model.tables, model.columns, model.relations, f"{out}/catalog")
    sinks.write_security(model.security, f"{out}/security")
    for name in STRUCTURE:
        keep(getattr(model, name), f"structure/{name}")
    table, measure, summary = lineage(model)
    sinks.write_lineage(table, measure, f"{out}/lineage")
    sinks.write_relation(summary, f"{out}/lineage/summary")
    result = decide_all(model, uses, views, security, mode=mode, schema=schema)
    doubtful = materialise(
        unread.join(model_of, "report_id").select("model_id").union(unread_ends.select("model_id")).distinct()
    )
    result = replace(
        result, drop_tables=result.drop_tables.join(doubtful, "model_id", "left_anti"),
        drop_columns=result.drop_columns.join(doubtful, "model_id", "left_anti"),
    )
    for name in ("counts", "columns", "tables", "model_items", "conflicts", "unmatched_usage", "unmatched_endpoints"):
        keep(getattr(result, name), f"decisions/{name}")
    keep(cleanup.implicit_value_columns(result.columns), "audit/implicit_value_columns")
    sinks.write_statements(result.drop_tables, f"{out}/sql/drop_tables")
    sinks.write_statements(result.drop_columns, f"{out}/sql/drop_columns")
    sinks.write_relation(decide.run_summary(result.drop_tables, result.drop_columns, result.model_items), f"{out}/summary")
    if cleanup_mode:
        edited, removed, skipped = (materialise(d) for d in clean_up(model, result, cleanup_mode))
        sinks.write_edited_files(edited, f"{out}/cleanup/files")
        sinks.record_edits(edited, f"{out}/cleanup/versions")
        sinks.write_report(removed, skipped, f"{out}/cleanup")
        keep(cleanup.cleanup_summary(removed, skipped), "cleanup/summary")
        keep(cleanup.not_deletable(skipped), "cleanup/not_deletable")
    sinks.write_relation(sinks.counts_relation(spark, counts), f"{out}/metrics")
    return result


def decide_stored(
    spark: SparkSession, stored: str, views: DataFrame | None = None, security: DataFrame | None = None,
    mode: str = "single_pass", schema: str = "dbo", fmt: str = "parquet",
) -> Decisions:
    """Decisions from the catalog, usage, security and structure that an earlier run wrote under ``stored``.

    No definition or report is read again, so lists, protection mode and schema can change cheaply.
    """
    tables, columns, relations = read_catalog(spark, f"{stored}/catalog")
    structure = {name: read_relation(spark, f"{stored}/structure/{name}", fmt) for name in STRUCTURE}
    model = Model(
        files=None, blocks=None, formulas=None, closure=None, tables=tables, columns=columns, relations=relations,
        unresolved=read_relation(spark, f"{stored}/audit/unresolved_relations", fmt), security=read_relation(spark, f"{stored}/security", fmt), **structure,
    )
    return decide_all(model, read_relation(spark, f"{stored}/usage", fmt), views, security, mode=mode, schema=schema)
