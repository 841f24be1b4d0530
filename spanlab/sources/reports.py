"""Reports of a run: structural quality, retrieval by model, comparisons, how to read them, and where they come from.

Spark aggregates a run's tables (`runs.read`, or those of the operators under `runs.entries`) to a row for each strategy and
model; those few rows are laid out as Markdown, HTML with charts, or text for a console. Rows are in the order of their names.
"""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions.numbers import poisoned_mean
from spanlab.operators.report import significance_marks

#: column, title, how it is shown, and whether more is better (None: neither).
STRUCTURAL = [
    ("localization_rate", "Located", "percent", None), ("clause_fragmentation_rate", "Leaf Frag ↓", "rate", False),
    ("top_level_over_merge_rate", "Over-merge ↓", "rate", False), ("sub_clause_grouping_rate", "Sub-clause Grp", "rate", None),
    ("heading_recall", "Head R", "rate", True), ("heading_precision", "Head P", "rate", True),
    ("definition_attachment_recall", "Def Attach ↑", "rate", True), ("xref_target_recall", "XRef R", "rate", True),
    ("xref_target_precision", "XRef P", "rate", True), ("chunk_size_cv", "Size CV", "rate", None), ("avg_chunk_chars", "Avg Chars", "count", None),
    ("chunk_count", "Chunks", "count", None),
]
OPTIONAL = ("heading_recall", "heading_precision", "xref_target_recall", "xref_target_precision")
RETRIEVAL = [(f"{n}_at_{k}", f"{n[0].upper()}@{k}", "rate", True) for n in ("precision", "recall") for k in (1, 3, 5, 10)]
RETRIEVAL += [("mrr", "MRR", "rate", True), ("ndcg_at_10", "NDCG@10", "rate", True), ("drm_rate", "DRM rate", "rate", False)]
COMPARISON = ["Metric", "A", "B", "n", "Δ", "95% CI", "p (Holm)", "p (Wilcoxon)", "Effect size (d)", "LODO range"]
#: The strategy whose chunks are as long as those of the clause-aware one.
CONTROL = "rcts_1024"


def shown(x: float | None, how: str = "rate") -> str:
    """n/a for null and not-a-number; infinite effects with their sign."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "n/a"
    if isinstance(x, float) and math.isinf(x):
        return "+inf" if x > 0 else "-inf"
    return {"rate": f"{x:.3f}", "percent": f"{100 * x:.3f}%", "count": f"{x:.0f}", "signed": f"{x:+.3f}"}[how]


def span(low: float | None, high: float | None) -> str:
    ends = [shown(x, "signed") for x in (low, high)]
    return "n/a" if "n/a" in ends else f"[{', '.join(ends)}]"


@dataclass
class Table:
    title: str
    note: str
    columns: list[str]
    rows: list[list[str]] = field(default_factory=list)
    #: (row, column) -> best or worst
    marks: dict[tuple[int, int], str] = field(default_factory=dict)


@dataclass
class Report:
    provenance: str
    structural: list[dict]
    by_document: list[dict]
    retrieval: list[dict]
    comparisons: list[dict]
    tables: list[Table]
    lengths: list[tuple[str, float]]


def _rows(frame: DataFrame | None, order: list[str]) -> list[dict]:
    return [] if frame is None else [r.asDict() for r in frame.orderBy(*order).collect()]


def _table(title: str, note: str, kinds: list[tuple], rows: list[dict], more: dict | None = None) -> Table:
    """A row for each strategy, with the best and worst of each column that has a direction where they differ."""
    out = Table(title, note, ["Strategy", *(k[1] for k in kinds)])
    for r in rows:
        out.rows.append([r["strategy"], *(shown(r[name], how) + (more or {}).get((r["strategy"], name), "") for name, _, how, _ in kinds)])
    for c, (name, _, _, more_is_better) in enumerate(kinds):
        values = [r[name] for r in rows if r[name] is not None]
        if more_is_better is None or not values or min(values) == max(values):
            continue
        best, worst = (max(values), min(values)) if more_is_better else (min(values), max(values))
        for k, r in enumerate(rows):
            if r[name] in (best, worst):
                out.marks[k, c + 1] = "best" if r[name] == best else "worst"
    return out


def report(parts: dict[str, DataFrame], head: dict | None = None) -> Report:
    """parts: those of structural_metrics, retrieval_metrics and comparisons that a run has. head: timestamp, version, commit,
    models, seed, strategy_parameters."""
    head = head or {}
    structural, retrieval, comparisons = (parts.get(n) for n in ("structural_metrics", "retrieval_metrics", "comparisons"))
    macro = by_document = means = marks = None
    if structural is not None:
        mean = lambda c: (poisoned_mean(F.col(c)) if c in OPTIONAL else F.avg(c)).alias(c)
        macro = structural.groupBy("strategy").agg(*[mean(c) for c, *_ in STRUCTURAL], F.countDistinct("document_id").alias("n"))
        quality = F.col("localization_rate") + 2 - F.col("clause_fragmentation_rate") - F.col("top_level_over_merge_rate") + F.col("definition_attachment_recall")
        by_document = structural.select("strategy", "document_id", (quality / 4).alias("quality"))
    if retrieval is not None:
        means = retrieval.groupBy("embedding_model", "strategy").agg(*[F.avg(c).alias(c) for c, *_ in RETRIEVAL], F.countDistinct("query_id").alias("n"))
    if comparisons is not None and means is not None:
        told = comparisons.select(F.col("embedding_model").alias("model"), F.col("metric_name").alias("metric"), "strategy_a", "strategy_b", F.col("p_value_holm").alias("p_holm"))
        strategies = told.select(F.col("strategy_b").alias("strategy"), "metric").distinct()
        marks = significance_marks(strategies, told).where("mark <> ''")
    rows = _rows(macro, ["strategy"])
    found = _rows(means, ["embedding_model", "strategy"])
    tests = _rows(comparisons, ["embedding_model", "metric_name", "strategy_a", "strategy_b"])
    stars = {(m["strategy"], m["metric"]): f" {m['mark']}" for m in _rows(marks, ["strategy", "metric"])}
    tables = []
    if rows:
        tables.append(_table("Structural quality", f"Means over documents (n = {max(r['n'] for r in rows)}), against annotated spans.", STRUCTURAL, rows))
    for model in sorted({r["embedding_model"] for r in found}):
        own = [r for r in found if r["embedding_model"] == model]
        tables.append(_table(f"Retrieval quality: {model}", f"Means over queries (n = {max(r['n'] for r in own)}).", RETRIEVAL, own, stars))
    for model in sorted({r["embedding_model"] for r in tests}):
        own = [r for r in tests if r["embedding_model"] == model]
        sizes = {r["n"] for r in own}
        note = f"{len(own)} tests, n = {sizes.pop() if len(sizes) == 1 else 'varies'} queries each. ** is significant after Holm's correction over all tests of the run."
        table = Table(f"Comparisons: {model}", note, COMPARISON)
        for r in own:
            control = f"**{r['strategy_b']} (size-matched control)**" if r["strategy_b"] == CONTROL else r["strategy_b"]
            table.rows.append([
                r["metric_name"], r["strategy_a"], control, str(r["n"]), shown(r["delta"], "signed"), span(r["ci_low"], r["ci_high"]),
                shown(r["p_value_holm"]) + (" **" if r["significant_holm"] else ""), shown(r["p_value_wilcoxon"]), shown(r["cohens_d"]),
                span(r["lodo_min_delta"], r["lodo_max_delta"]),
            ])
        tables.append(table)
    models = head.get("models") or sorted({r["embedding_model"] for r in found})
    parameters = json.dumps(head["strategy_parameters"], sort_keys=True) if head.get("strategy_parameters") else "n/a"
    line = (
        f"Generated {head.get('timestamp', 'n/a')}, version {head.get('version', 'n/a')} (commit {head.get('commit', 'n/a')}); models: {', '.join(models) or 'n/a'}; "
        f"seed {head.get('seed', 'n/a')}; {max((r['n'] for r in rows), default=0)} documents; {max((r['n'] for r in found), default=0)} queries; parameters: {parameters}"
    )
    return Report(line, rows, _rows(by_document, ["strategy", "document_id"]), found, tests, tables, [(r["strategy"], r["avg_chunk_chars"]) for r in rows])


READING = "Mean length of chunks by strategy. Retrieval is only compared at equal size where these are close; elsewhere a gain may be one of size."


def markdown(r: Report) -> str:
    out = [f"_{r.provenance}._"]
    for name, some in (("Structural quality", r.structural), ("Retrieval quality", r.retrieval), ("Comparisons", r.comparisons)):
        if not some:
            out.append(f"### {name}\n\n_This run has none._")
        for t in (t for t in r.tables if t.title.startswith(name)):
            line = lambda cells: "| " + " | ".join(cells) + " |"
            out.append("\n".join([f"### {t.title}", "", t.note, "", line(t.columns), "|" + "---|" * len(t.columns), *map(line, t.rows)]))
    lengths = "\n".join(f"- `{s}`: {shown(n, 'count')} characters a chunk" for s, n in r.lengths) or "_Not known: this run has no structural metrics._"
    return "\n\n".join([*out, f"### How to read this\n\n{READING}\n\n{lengths}"]) + "\n"


def console(r: Report, colour: bool = True) -> str:
    """Padded tables; the best of a column is green and the worst red, or + and - without colour."""
    paint = {"best": ("\x1b[32m", "\x1b[0m"), "worst": ("\x1b[31m", "\x1b[0m")} if colour else {"best": ("", "+"), "worst": ("", "-")}
    out = [r.provenance]
    for t in r.tables:
        widths = [max(len(row[c]) for row in [t.columns, *t.rows]) for c in range(len(t.columns))]
        pad = lambda cell, c: cell.ljust(widths[c]) if c == 0 else cell.rjust(widths[c])
        lines = [t.title, t.note, "  ".join(pad(x, c) for c, x in enumerate(t.columns))]
        for k, row in enumerate(t.rows):
            cells = [pad(x, c) if (k, c) not in t.marks else "".join((paint[t.marks[k, c]][0], pad(x, c), paint[t.marks[k, c]][1])) for c, x in enumerate(row)]
            lines.append("  ".join(cells).rstrip())
        out.append("\n".join(lines))
    return "\n\n".join(out) + "\n"


COLOURS = ("#3b6ea5", "#c1782f", "#4f8f5b", "#8a5a9e", "#a8484f", "#6b6f76", "#2f8f9d", "#b59a2b", "#7a4b2a", "#51617a", "#9c6f8f")


def bars(title: str, groups: list[str], series: list[tuple[str, list[float | None]]], top: float = 1.0) -> str:
    """Grouped bars as SVG: a group for each name, a bar for each series; nulls have none."""
    width = 60 + max(1, len(groups)) * (14 * len(series) + 24)
    e = html.escape
    out = [f"<svg role='img' viewBox='0 0 {width} 260' width='{width}' height='260' font-family='sans-serif' font-size='11'><title>{e(title)}</title>"]
    out += [f"<text x='8' y='16' font-size='13'>{e(title)}</text>", *(f"<text x='4' y='{214 - 160 * k / 4:.0f}'>{top * k / 4:.2f}</text>" for k in range(5))]
    for g, name in enumerate(groups):
        left = 50 + g * (14 * len(series) + 24)
        for s, (label, values) in enumerate(series):
            if values[g] is not None:
                size = 160 * min(max(values[g] / top, 0.0), 1.0)
                out.append(f"<rect x='{left + 14 * s}' y='{210 - size:.1f}' width='12' height='{size:.1f}' fill='{COLOURS[s % len(COLOURS)]}'><title>{e(name)}, {e(label)}: {values[g]:.3f}</title></rect>")
        out.append(f"<text x='{left}' y='225'>{e(name)}</text>")
    for s, (label, _) in enumerate(series):
        out.append(f"<rect x='{50 + 110 * s}' y='238' width='10' height='10' fill='{COLOURS[s % len(COLOURS)]}'/><text x='{64 + 110 * s}' y='247'>{e(label)}</text>")
    return "".join([*out, "</svg>"])


def heatmap(title: str, cells: dict[tuple[str, str], float]) -> str:
    """Strategies by documents, from white (0) to full colour (1)."""
    rows, columns = sorted({s for s, _ in cells}), sorted({d for _, d in cells})
    e = html.escape
    out = [f"<svg role='img' viewBox='0 0 {160 + 70 * len(columns)} {60 + 26 * len(rows)}' width='{160 + 70 * len(columns)}' font-family='sans-serif' font-size='11'><title>{e(title)}</title><text x='8' y='16' font-size='13'>{e(title)}</text>"]
    out += [f"<text x='{150 + 70 * c}' y='36'>{e(str(d))[:10]}</text>" for c, d in enumerate(columns)]
    for k, s in enumerate(rows):
        out.append(f"<text x='8' y='{62 + 26 * k}'>{e(s)}</text>")
        for c, d in enumerate(columns):
            if (s, d) in cells:
                out.append(f"<rect x='{150 + 70 * c}' y='{44 + 26 * k}' width='66' height='24' fill='{COLOURS[0]}' fill-opacity='{min(max(cells[s, d], 0), 1):.3f}'/><text x='{165 + 70 * c}' y='{61 + 26 * k}'>{cells[s, d]:.3f}</text>")
    return "".join([*out, "</svg>"])


def charts(r: Report) -> list[str]:
    """Structural quality, the same by document, retrieval of each model, NDCG of all models, and document mismatch."""
    out = []
    names = [x["strategy"] for x in r.structural]
    if names:
        less = lambda c: [1 - x[c] for x in r.structural]
        out.append(bars("Structural quality by strategy", names, [
            ("Located", [x["localization_rate"] for x in r.structural]), ("1 - Leaf Frag", less("clause_fragmentation_rate")),
            ("1 - Over-merge", less("top_level_over_merge_rate")), ("Def Attach", [x["definition_attachment_recall"] for x in r.structural]),
        ]))
        out.append(heatmap("Structural quality by strategy and document", {(x["strategy"], x["document_id"]): x["quality"] for x in r.by_document}))
    models = sorted({x["embedding_model"] for x in r.retrieval})
    for model in models:
        own = [x for x in r.retrieval if x["embedding_model"] == model]
        some = [(t, [x[c] for x in own]) for c, t, *_ in RETRIEVAL if c in ("precision_at_1", "precision_at_5", "recall_at_5", "mrr", "ndcg_at_10")]
        out.append(bars(f"Retrieval by strategy: {model}", [x["strategy"] for x in own], some))
    if models:
        all_ = sorted({x["strategy"] for x in r.retrieval})
        of = {(x["embedding_model"], x["strategy"]): x for x in r.retrieval}
        each = lambda c: [(m, [of[m, s][c] if (m, s) in of else None for s in all_]) for m in models]
        out.append(bars("NDCG@10 by strategy and model", all_, each("ndcg_at_10")))
        out.append(bars("Document mismatch by strategy and model", all_, each("drm_rate")))
    return out


def page(r: Report, title: str = "spanlab") -> str:
    e = html.escape
    body = [f"<h1>{e(title)}</h1><p>{e(r.provenance)}</p>"]
    for t in r.tables:
        head = "".join(f"<th>{e(c)}</th>" for c in t.columns)
        rows = ("".join(f"<td{f' class={t.marks[k, c]}' if (k, c) in t.marks else ''}>{e(x)}</td>" for c, x in enumerate(row)) for k, row in enumerate(t.rows))
        body.append(f"<h2>{e(t.title)}</h2><p>{e(t.note)}</p><table><tr>{head}</tr>{''.join(f'<tr>{x}</tr>' for x in rows)}</table>")
    style = "<style>.best{color:#1b6e3c}.worst{color:#a3262a}td{text-align:right}td:first-child{text-align:left}</style>"
    return f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title>{style}{''.join(body)}{''.join(charts(r))}"
