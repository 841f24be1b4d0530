"""python -m spanlab.cli COMMAND: evidence, structural or report over a folder of Parquet tables."""

from __future__ import annotations

import argparse
from pathlib import Path

from spanlab.plans import catalog
from spanlab.session import session
from spanlab.sources import config, reports, results, runs

COMMANDS = {"evidence": ["agg3_evidence_score", "agg4_evidence_means"], "structural": ["sm9_structural_row", "agg7_macro_average"], "retrieval": ["rm2_rm8_metrics", "agg9_retrieval_means"], "statistics": ["st9_comparison_matrix"]}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanlab", description=__doc__)
    parser.add_argument("command", choices=[*COMMANDS, "query", "report"])
    parser.add_argument("--tables", required=True, help="folder of the tables, or of a nested run for report")
    parser.add_argument("--name", help="a query's name, for query")
    parser.add_argument("--config")
    parser.add_argument("--seed", type=int)
    parser.add_argument("--output-dir")
    a = parser.parse_args(arguments)
    settings = config.load(a.config, seed=a.seed, output_dir=a.output_dir)
    out = Path(settings.output_dir)
    out.mkdir(parents=True, exist_ok=True)
    spark = session()
    if a.command == "report":
        parts = runs.read(spark, a.tables)
        head = parts["runs"].first()
        made = reports.report({n: parts[n] for n in runs.ENTRIES if not parts[n].isEmpty()}, head.asDict() if head else {})
        for name, text in (("report.html", reports.page(made)), ("report.md", reports.markdown(made))):
            (out / name).write_text(text, encoding="utf-8")
        print(reports.console(made))
        skipped = parts["skipped"].count()
        if skipped:
            print(f"{skipped} malformed entries were left out")
        return 0
    built = catalog.queries()
    names = [a.name] if a.command == "query" else COMMANDS[a.command]
    tables = {n: built[n](spark, a.tables) for n in names}
    results.save_tables(tables, str(out / "tables"), results.manifest(spark, vars(a), settings.seed))  # whole; JSON is for the summary alone, the last of a command
    results.export_json({names[-1]: tables[names[-1]]}, str(out / "results.json"), seed=settings.seed)
    for n, t in tables.items():
        print(n)
        t.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
