"""Command line: analyze, label, kappa, extract-patterns and alter."""

from __future__ import annotations

import argparse
import importlib.util
import json
from types import ModuleType

from pyspark.sql import functions as F

from quillspark import __version__, sinks
from quillspark.operators import labeling
from quillspark.operators.agreement import rolling_kappa_for_fields
from quillspark.operators.store import pairwise_labels
from quillspark.plans import analysis, corpus, extraction
from quillspark.session import drop_tables, get_session, materialize
from quillspark.sources import files
from quillspark.sources.label_files import stored_label_members


def load_module(path: str) -> ModuleType:
    """A user's configuration file: ``CONFIG``, and optionally ``units(spark, path)``, ``MINER``, ``CONSOLIDATOR``, ``PROVIDER``."""
    spec = importlib.util.spec_from_file_location("quillspark_config", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"cannot load configuration {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def condition(text: str) -> tuple[str, object]:
    """``field=value``; a value that is a JSON number, boolean or null is taken as such, anything else as text."""
    field, _, value = text.partition("=")
    try:
        parsed = json.loads(value)
    except ValueError:
        parsed = value
    return field, value if isinstance(parsed, dict | list) else parsed


def _analyze(spark, args) -> None:
    provider = getattr(load_module(args.config), "PROVIDER", analysis.parsed_tables) if args.config else analysis.parsed_tables
    found = analysis.analyze(files.python_sources(spark, args.root, args.project), args.stored, provider)
    analysis.write_report(found, args.out)


def _label(spark, args) -> None:
    module = load_module(args.config)
    if args.command == "label-units":
        docs = module.units(spark, args.root)
    else:
        docs = files.text_files(spark, args.root, args.suffix)
    labeled = corpus.label_corpus(docs, module.CONFIG, corpus.Store(args.store), fresh=args.fresh)
    if args.out:
        sinks.result_rows(labeling.report_rows(labeled), args.out)
    labeling.decision_summary(labeled).show(truncate=False)


def _kappa(spark, args) -> None:
    labels = corpus.Store(args.store).read(spark, "labels")
    pairs = pairwise_labels(labels, args.agent_a, args.agent_b)
    how = {"combinations": None} if args.no_filter else {}
    series = rolling_kappa_for_fields(pairs, args.field, args.window, **how)
    if args.out:
        series.write.mode("overwrite").parquet(args.out)
    series.orderBy(F.desc("created_at"), F.desc("doc_id")).show(20, truncate=False)


def _extract(spark, args) -> None:
    module = load_module(args.config)
    members = materialize(stored_label_members(spark, args.root))
    files.unread_files(members).show(truncate=False)
    entries = files.entries_of(members)
    for field in dict.fromkeys(args.field):
        found = extraction.extract_patterns(
            entries, field, args.value, args.reasoning_field, module.MINER, getattr(module, "CONSOLIDATOR", None),
            args.max_examples, args.chunk_size,
        )
        print(found.summary)
        if args.out:
            out = args.out if len(set(args.field)) == 1 else f"{args.out}/{field}"
            about = [F.lit(field).alias("field_name"), F.lit(args.value).alias("field_value")]
            found.patterns.select(*about, "*").write.mode("overwrite").json(f"{out}/patterns")
            found.references.select(*about, "*").write.mode("overwrite").json(f"{out}/references")
            spark.createDataFrame([(field, args.value, str(found.summary))], "field_name string, field_value string, summary string").write.mode(
                "overwrite").json(f"{out}/summary")


def _alter(spark, args) -> None:
    module = load_module(args.config)
    conditions = [condition(c) for c in args.where]
    counts, errors = corpus.alter_corpus(spark, args.root, args.out, conditions, module.CONFIG, args.dry_run)
    print(counts.asDict())
    errors.show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, spec in options.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **spec)

    needed = {"required": True}
    command("analyze", _analyze, root=needed, out=needed, project={}, config={}, stored={})
    for name in ("label-dir", "label-units"):
        command(name, _label, root=needed, config=needed, store=needed, out={}, suffix={"default": ".py"}, fresh={"action": "store_true"})
    command("kappa", _kappa, store=needed, agent_a={"default": "labeler_a"}, agent_b={"default": "labeler_b"},
            field={"action": "append", "required": True}, window={"type": int, "default": 50}, no_filter={"action": "store_true"}, out={})
    command("extract-patterns", _extract, root=needed, config=needed, field={"action": "append", "required": True}, value=needed,
            reasoning_field={"default": "reasoning"}, max_examples={"type": int, "default": 50}, chunk_size={"type": int, "default": 20}, out={})
    command("alter", _alter, root=needed, config=needed, out=needed, where={"action": "append", "required": True},
            dry_run={"action": "store_true"})
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session("quillspark")
    try:
        args.run(spark, args)
    finally:
        drop_tables(spark)


if __name__ == "__main__":
    main()
