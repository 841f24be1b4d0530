"""Reports in their three forms, by hand, and the settings of the two benchmarks."""

import re

import pytest

from spanlab.sources import config, reports, runs


@pytest.fixture(scope="module")
def parts(spark):
    kinds = lambda part: ", ".join(f"{n} {t}" for n, t, _, _ in runs.fields(part))
    row = lambda part, **own: tuple(own.get(n, {"string": "x", "bigint": 1, "double": 0.5, "boolean": False}[t]) for n, t, _, _ in runs.fields(part))
    structural = [
        row("structural_metrics", strategy="b", document_id="d1", clause_fragmentation_rate=0.2, heading_recall=None, avg_chunk_chars=400.0),
        row("structural_metrics", strategy="b", document_id="d2", clause_fragmentation_rate=0.4, heading_recall=1.0, avg_chunk_chars=500.0),
        row("structural_metrics", strategy="a<", document_id="d1", clause_fragmentation_rate=0.1, heading_recall=0.75, localization_rate=1.0, avg_chunk_chars=800.0),
    ]
    retrieval = [row("retrieval_metrics", query_id=q, strategy=s, embedding_model=m, mrr=v) for q, s, m, v in (("1", "b", "m", 0.5), ("2", "b", "m", 1.0), ("1", "a<", "m", 0.25), ("1", "b", "k", 0.125))]
    tests = [
        row("comparisons", metric_name="mrr", strategy_a="a<", strategy_b="b", embedding_model="m", n=2, delta=-0.25, ci_low=-0.5, ci_high=float("nan"), p_value_holm=0.004, significant_holm=True, cohens_d=float("inf"), lodo_min_delta=-0.5, lodo_max_delta=0.25),
        row("comparisons", metric_name="mrr", strategy_a="a<", strategy_b="rcts_1024", embedding_model="m", n=3),
    ]
    made = {"structural_metrics": structural, "retrieval_metrics": retrieval, "comparisons": tests}
    return {part: spark.createDataFrame(rows, kinds(part)) for part, rows in made.items()}


HEAD = {"timestamp": "today", "version": "1", "commit": "abc", "seed": 7, "strategy_parameters": {"b": 1}}


def test_markdown(parts):
    text = reports.markdown(reports.report(parts, HEAD))
    assert text.startswith('_Generated today, version 1 (commit abc); models: k, m; seed 7; 2 documents; 2 queries; parameters: {"b": 1}._\n\n### Structural quality\n')
    lines = text.splitlines()
    table = [x for x in lines if x.startswith("| b ") or x.startswith("| a< ")]
    # Means over documents; a null makes the mean of an optional metric null.
    assert table[0] == "| a< | 100.000% | 0.100 | 0.500 | 0.500 | 0.750 | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 800 | 1 |"
    assert table[1] == "| b | 50.000% | 0.300 | 0.500 | 0.500 | n/a | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 450 | 1 |"
    assert [x for x in lines if x.startswith("### ")] == ["### Structural quality", "### Retrieval quality: k", "### Retrieval quality: m", "### Comparisons: m", "### How to read this"]
    assert "| b | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 0.500 | 0.750 ** | 0.500 | 0.500 |" in lines
    assert "| mrr | a< | b | 2 | -0.250 | n/a | 0.004 ** | 0.500 | +inf | [-0.500, +0.250] |" in lines
    assert "| mrr | a< | **rcts_1024 (size-matched control)** | 3 | +0.500 | [+0.500, +0.500] | 0.500 | 0.500 | 0.500 | [+0.500, +0.500] |" in lines
    assert "2 tests, n = varies queries each." in text and text.endswith("- `a<`: 800 characters a chunk\n- `b`: 450 characters a chunk\n")


def test_console(parts):
    text = reports.console(reports.report(parts, HEAD), colour=False)
    rows = {line.split()[0]: line for line in text.splitlines() if line.startswith(("a< ", "b  "))}
    assert "0.100+" in text and "0.300-" in text and "0.750 **+" in text and "0.250-" in text and rows
    assert "\x1b[32m" in reports.console(reports.report(parts, HEAD)) and "0.500+" not in text  # equal values have no marks


def test_page(parts):
    made = reports.report(parts, HEAD)
    text = reports.page(made, "run <1>")
    assert "<h1>run &lt;1&gt;</h1>" in text and "<td>a&lt;</td>" in text and "a<<" not in text
    drawn = reports.charts(made)
    titles = [re.search("<title>(.*?)</title>", c)[1] for c in drawn]
    assert titles == ["Structural quality by strategy", "Structural quality by strategy and document", "Retrieval by strategy: k", "Retrieval by strategy: m", "NDCG@10 by strategy and model", "Document mismatch by strategy and model"]
    assert all(c in text for c in drawn) and drawn[1].count("<rect") == 3 and drawn[4].count("<rect") == 3 + 2  # strategies that a model lacks have no bar
    assert "<td class=best>0.100</td>" in text and "<td class=worst>0.300</td>" in text


def test_empty_runs():
    text = reports.markdown(reports.report({}))
    assert text.count("_This run has none._") == 3 and "Not known" in text and reports.charts(reports.report({})) == []
    assert reports.shown(float("-inf")) == "-inf" and reports.shown(float("nan")) == "n/a" and reports.span(None, 1.0) == "n/a"


def test_evidence_settings(tmp_path):
    path = tmp_path / "spanlab.yaml"
    path.write_text("benchmark: {seed: 3}\nevidence: {strategies: [token_window, rcts_512], retrieval_depth: 7, dataset_path: data/set.json}\n")
    got = config.load_evidence(str(path), output_path="/out")
    assert (got.strategies, got.retrieval_depth, got.context_budget_tokens) == (("token_window", "rcts_512"), 7, 128)
    assert got.dataset_path == str(tmp_path / "data/set.json") and got.output_path == "/out"
    assert config.load(str(path)).seed == 3
    path.write_text("retrieval_depth: 9\n")
    assert config.load_evidence(str(path)).retrieval_depth == 9  # a file without sections is all settings
    assert got.chunkers()["token_window"] == {"window": 64, "overlap": 8}


@pytest.mark.parametrize(
    ("settings", "told"),
    [
        ("{retrieval_depth: 0}", "retrieval_depth"), ("{context_budget_tokens: true}", "context_budget_tokens"), ("{token_window_overlap: 64}", "token_window_overlap"),
        ("{rcts_chunk_overlap: -1}", "rcts_chunk_overlap"), ("{strategies: []}", "strategies"), ("{strategies: [token_window, token_window]}", "strategies"),
        ("{strategies: token_window}", "strategies"), ("{strategies: [none]}", "unknown strategies"), ("{other: 1}", "unknown settings"), ("[1]", "object"), ("{dataset_path: 3}", "dataset_path"),
    ],
)
def test_wrong_evidence_settings(tmp_path, settings, told):
    path = tmp_path / "c.yaml"
    path.write_text(f"evidence: {settings}\n" if settings != "[1]" else settings)
    with pytest.raises(config.ConfigError, match=told):
        config.load_evidence(str(path))


def test_command_line(spark, parts, tmp_path, capsys):
    """A run is exported and reported on; tables are saved with the manifest of how they were made."""
    from spanlab import __version__, cli
    from spanlab.sources import results

    runs.export(spark, parts, str(tmp_path / "run"), seed=7, models=["m"], timestamp="then")
    assert cli.main(["report", "--tables", str(tmp_path / "run"), "--output-dir", str(tmp_path / "out")]) == 0
    assert "Generated then" in capsys.readouterr().out and "seed 7" in (tmp_path / "out" / "report.md").read_text()
    assert "<svg" in (tmp_path / "out" / "report.html").read_text()
    results.save_tables({"structural": parts["structural_metrics"]}, str(tmp_path / "saved"), results.manifest(spark, {"top_k": 1}, 3))
    row = spark.read.json(str(tmp_path / "saved" / "manifest")).first()
    assert (row.version, row.seed, len(row.package_sha256)) == (__version__, 3, 64)
    (tmp_path / ".git").mkdir()
    assert results.commit(str(tmp_path)) is None
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/x\n")
    (tmp_path / ".git" / "packed-refs").write_text("# pack\nabc refs/heads/x\n")
    assert results.commit(str(tmp_path)) == "abc"
