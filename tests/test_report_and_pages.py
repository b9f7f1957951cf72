import base64
from pathlib import Path

import pandas as pd
import pytest

from tallyframe.operators.charts import BoxChart, Chart, HeatChart, ScatterChart
from tallyframe.operators.report import Report, markdown_html
from tallyframe.operators.variables import Variable
from tallyframe.plans.common import survey
from tallyframe.sources.questionnaire import Page, Questionnaire, SingleChoice

SF = "/root/testdata/sf0.001"


class Drawn(Chart):
    """A chart whose drawing needs no package."""

    def save(self, path, dpi=150):
        Path(path).write_bytes(b"png")
        return path


class Axes:
    """Keeps the calls that a drawing makes."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, a, k))


def test_report_takes_tables_charts_and_frames_only(tmp_path):
    with pytest.raises(TypeError):
        Report().add("not a component")
    frame = pd.DataFrame({"a": [1], "b": ["x|y"]})
    report = Report("R").add(frame, caption="Table 1").add(Drawn("Fig", None), caption="Fig 1").markdown("- [R](#r)\n- **bold** <b>")
    text = report.to_markdown(tmp_path)
    assert (tmp_path / "chart-1.png").exists() and "(chart-1.png)" in text and "| a | b |" in text and "*Fig 1*" in text
    page = report.to_html()
    assert "<table>" in page and "<h1>R</h1>" in page and f"data:image/png;base64,{base64.b64encode(b'png').decode()}" in page
    assert '<a href="#r">R</a>' in page and "<strong>bold</strong> &lt;b&gt;" in page
    combined = Report.combine([report, Report("Other").text("x")], title="All")
    assert "## Contents" in combined.to_markdown(tmp_path) and '<li><a href="#other">Other</a></li>' in combined.to_html()


def test_markdown_as_html():
    assert markdown_html("# A b\n\n> n\n\n---\n\ntext `c`") == '<h1 id="a-b">A b</h1>\n<blockquote>n</blockquote>\n<hr>\n<p>text <code>c</code></p>'


def test_charts_are_drawn_by_kind(spark):
    plot = survey(spark, SF, "lineitem", Variable("l_returnflag", "nominal", labels={"A": "Accepted"})).plot
    charts = [plot.bar("l_returnflag"), plot.boxplot("l_quantity", by="l_returnflag"), plot.heatmap(["l_discount", "l_tax"]), plot.scatter("l_quantity", "l_tax", points=20)]
    assert [type(c) for c in charts] == [Chart, BoxChart, HeatChart, ScatterChart]
    calls = []
    for chart in charts:
        axes = Axes()
        chart.draw(axes, chart.data.toPandas())
        calls.append([c[0] for c in axes.calls])
    assert calls[0] == ["bar"] and calls[1] == ["bxp"] and calls[2][0] == "imshow" and calls[2].count("text") == 4 and calls[3][:2] == ["scatter", "plot"]
    assert charts[3].data.count() == 20


def page(name, **more):
    return Page(name, [SingleChoice(name, Variable(f"v_{name}", "nominal", labels={1: "a"}), id=name)], **more)


def test_terminal_pages_keep_the_next_page():
    asked = Questionnaire("Q", [page("intro"), Page("out", kind="disqualification"), Page("end", kind="final"), Page("go", kind="redirect", redirect_url="https://x")])
    asked.validate()
    assert asked.graph() == {"intro": {"out"}, "out": {"end"}, "end": {"go"}, "go": set()}
    with pytest.raises(ValueError, match="out of reach"):
        Questionnaire("Q", [page("a", default_next="c"), page("b"), page("c")]).validate()


def test_lint_levels():
    asked = Questionnaire("Q", [Page("empty"), page("b", default_next="c"), page("c")])
    assert [(w.code, w.severity) for w in asked.lint()] == [("EMPTY_PAGE", "warning"), ("REDUNDANT_NAVIGATION", "warning")]
    assert asked.lint("strict")[0].severity == "error"
    hidden = Questionnaire("Q", [Page("p", [SingleChoice("q", Variable("v", "nominal", labels={1: "a"}), required=True, hide_if="x")])])
    assert not hidden.lint("strict")
    assert [w.code for w in Questionnaire("Q").lint()] == ["EMPTY_QUESTIONNAIRE"]
    with pytest.raises(ValueError):
        asked.lint("loud")


def test_a_variable_needs_a_name():
    with pytest.raises(ValueError):
        Variable(" ")
