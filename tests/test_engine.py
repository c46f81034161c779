"""Rendering and reporting over small trees."""

import json
import subprocess

import pytest

from loomtext.plans import adaptive, engine, sections, template
from loomtext.plans.engine import Engine, EngineError, Options

FILES = {
    "context/sections.yaml": """
meta:
  mode-sets:
    ai: {title: AI, modes: {ask: {title: Ask, tags: [ask], runs: {com.x.cli: run}}, do: {title: Do, tags: [do], default_task: "Do it.", vcs_mode: changes}}}
  tag-sets:
    lang: {title: Lang, tags: {python: Python, docs: {title: Docs}}}
all:
  extends: [meta]
  extensions: [.py, .md]
  filters: {mode: block, block: ["/context/"], when: [{condition: "tag:nosub", block: ["/pkg/sub/"]}]}
  python: {skip_trivial_files: true}
py:
  extensions: [.py]
  filters: {mode: allow, allow: ["/pkg/"]}
  path_labels: basename
  targets: [{match: "pkg/*", python: {comment_policy: strip_all, placeholders: {min_savings_ratio: 0}}}]
docs:
  extensions: [.md]
  filters: {mode: allow, allow: ["*.md"], block: ["/context/"]}
""",
    "context/sub/one.sec.yaml": "inner: {extends: [docs], extensions: [.md], filters: {mode: allow, allow: ['/README.md']}}\n",
    "context/many.sec.yaml": "a: {filters: {mode: block}}\nb: {extends: a}\n",
    "context/sub/part.tpl.md": "part of ${inner}\n",
    "context/main.ctx.md": "---\ninclude: [all]\n---\n# Main\n\n${docs}\n{# gone #}{% if tag:ask %}asked{% else %}not asked{% endif %}\n${tpl:sub/part}${task:prompt:\"Say\\n\\\"it\\\"\"}\n{% mode ai:ask %}{% if tag:ask %}inside{% endif %}{% endmode %}\n",
    "context/md.ctx.md": "# T\n\n## Guide\n\n${md:README}\n\n## Part\n\n${md:README#usage-notes}\n",
    "README.md": "# Read me\n\nHello.\n\n## Usage notes\n\nuse\n\n## Other\n\nother\n",
    "pkg/__init__.py": "from .a import x\n",
    "pkg/a.py": "# a comment that is quite long and goes on and on and on\nx = 1\n",
    "pkg/sub/a.py": "y = 2\n",
    "pkg/empty.py": "",
    "skip/me.py": "z = 3\n",
    ".gitignore": "skip/\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_sections_render_as_fences_in_path_order(spark, tree):
    text = Engine(spark, str(tree)).render("sec:all")
    assert text.index("README.md") < text.index("python:pkg/a.py") < text.index("python:pkg/sub/a.py")
    assert "```python:pkg/sub/a.py\ny = 2\n```\n" in text
    assert "__init__" not in text and "empty.py" not in text and "skip/" not in text and "gitignore" not in text
    assert text.endswith("```\n") and "<!-- FILE: README.md -->" in text


def test_documents_render_without_fences(spark, tree):
    text = Engine(spark, str(tree)).render("docs")
    assert text.startswith("# Read me\n<!-- FILE: README.md -->\n") and "```" not in text


def test_labels_targets_and_conditions(spark, tree):
    text = Engine(spark, str(tree)).render("sec:py")
    assert "```python:pkg/a.py" in text and "```python:sub/a.py" in text
    assert "on and on" not in text and "comment omitted" in text
    assert "pkg/sub" not in Engine(spark, str(tree), Options(tags=frozenset({"nosub"}))).render("sec:all")


def test_contexts(spark, tree):
    plain = Engine(spark, str(tree)).render("ctx:main")
    assert "not asked" in plain and "gone" not in plain and "inside" in plain and 'Say\n"it"' in plain
    assert plain.startswith("# Main") and plain.count("Hello.") == 2 and "part of # Read me" in plain
    asked = Engine(spark, str(tree), Options(modes={"ai": "ask"}, task="Real task")).render("main")
    assert "\nasked" in asked and "Real task" in asked
    with pytest.raises(adaptive.UnknownModeError):
        Engine(spark, str(tree), Options(modes={"ai": "none"})).render("main")


def test_markdown_placeholders_fit_their_place(spark, tree):
    text = Engine(spark, str(tree)).render("ctx:md")
    guide, part = text.split("## Part")
    assert "Read me" not in guide and "### Usage notes" in guide
    assert "### Usage notes" in part and "other" not in part


def test_reports(spark, tree):
    out = Engine(spark, str(tree), Options(limit=1000)).report("ctx:main")
    assert out["protocol"] == 5 and [f["path"] for f in out["files"]] == ["README.md"]
    assert out["context"]["sectionsUsed"] == {"sec:docs": 1, "sec:sub/inner": 1} and out["context"]["templateOnlyTokens"] >= 0
    assert abs(sum(f["promptShare"] for f in out["files"]) - 100) < 1e-9
    assert out["total"]["savedTokens"] < 0 and out["total"]["renderedTokens"] > 0
    section = Engine(spark, str(tree)).report("sec:py")
    assert "context" not in section and section["total"]["metaSummary"]["python.removed.comment"] == 1
    json.dumps(section)


def test_changes(spark, tree):
    class Fake:
        def changed(self):
            return {"pkg/sub/a.py"}

        def branch_changed(self, target=None):
            return set()

    text = Engine(spark, str(tree), Options(modes={"ai": "do"}), vcs=Fake()).render("sec:all")
    assert "sub/a.py" in text and "README" not in text and "pkg/a.py:" not in text


def test_git_changes(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-qm", "x")
    git("checkout", "-qb", "work")
    (tree / "pkg/a.py").write_text("x = 5\n")
    git("commit", "-qam", "y")
    (tree / "new.py").write_text("n = 1\n")
    from loomtext.sources.changes import GitChanges, NoChanges

    assert GitChanges(str(tree)).changed() == {"new.py"}
    assert GitChanges(str(tree)).branch_changed() == {"new.py", "pkg/a.py"}
    assert NoChanges().branch_changed() == set()


def test_lists(spark, tree):
    e = Engine(spark, str(tree))
    assert [s["name"] for s in e.list_sections()] == ["all", "docs", "many/a", "py", "sub/inner"]
    assert [s["name"] for s in e.list_sections("main")] == ["all", "docs", "sub/inner"]
    assert e.list_contexts() == ["main", "md"] and e.list_contexts("com.x.cli") == ["main"] and e.list_contexts("clipboard") == ["main", "md"]
    assert [r.mode_id for r in e.list_mode_sets("main", "com.x.cli").collect()] == ["ask"]
    assert [r.tag_id for r in e.list_tag_sets("main").collect()] == ["docs", "python"]
    with pytest.raises(adaptive.AdaptiveError):
        e.list_mode_sets("main", "com.y.cli")


def test_errors(spark, tree):
    e = Engine(spark, str(tree))
    for bad in ("sec:none", "ctx:none", "sec:meta"):
        with pytest.raises(ValueError):
            e.render(bad)
    (tree / "context/loop.ctx.md").write_text("${ctx:loop}")
    with pytest.raises(template.TemplateError):
        e.render("ctx:loop")
    (tree / "context/sections.yaml").write_text("a: {extends: [b], filters: {mode: block}}\nb: {extends: [a]}\n")
    with pytest.raises(adaptive.CycleError):
        e.render("sec:a")


def test_a_wrong_anchor_is_the_callers_error(spark, tree):
    (tree / "context/bad.ctx.md").write_text("# T\n\n${md:README#no-such-part}\n")
    with pytest.raises(EngineError, match="no-such-part"):
        Engine(spark, str(tree)).render("ctx:bad")


def test_processed_texts_and_counts_are_kept_between_runs(spark, tree, tmp_path, monkeypatch):
    from loomtext.operators.code import frames

    where = str(tmp_path / "kept")
    first = Engine(spark, str(tree), Options(cache=where)).report("sec:all")
    seen = []
    made = frames.processed_files
    monkeypatch.setattr(frames, "processed_files", lambda files, *a, **k: seen.append(files.count()) or made(files, *a, **k))
    assert Engine(spark, str(tree), Options(cache=where)).report("sec:all") == first == Engine(spark, str(tree)).report("sec:all")
    assert seen[0] == 0
    (tree / "pkg/sub/a.py").write_text("y = 3\n")
    assert "y = 3" in Engine(spark, str(tree), Options(cache=where)).render("sec:all") and seen[2] == 1


def test_nothing_stays_cached(spark, tree):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    e = Engine(spark, str(tree))
    e.report("ctx:main")
    e.render("sec:all")
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_other_placeholders_and_processors(spark, tree, monkeypatch):
    monkeypatch.setattr(template, "RULES", list(template.RULES))
    monkeypatch.setattr(template, "EVALUATORS", {})
    monkeypatch.setattr(template, "PROCESSORS", [])
    template.register("upper", 999, lambda body: template.Node("upper", {"of": body[3:]}) if body.startswith("up:") else None)
    template.register_evaluator("upper", lambda args, ev: args["of"].upper() + (" asked" if "ask" in ev.state.tags else ""))
    template.register_processor(lambda text, ev: text.replace("HELLO", "HALLO"))
    (tree / "context/own.ctx.md").write_text("${up:hello} ${tpl:inner}\n")
    (tree / "context/inner.tpl.md").write_text("${up:hello}")
    assert Engine(spark, str(tree), Options(tags=frozenset({"ask"}))).render("ctx:own").strip() == "HALLO asked HALLO asked"


def test_diagnosis_and_init(spark, tree, tmp_path):
    e = Engine(spark, str(tree))
    d = e.diagnose()
    assert all(c["ok"] for c in d["checks"]) and len(d["config"]["fingerprint"]) == 40
    assert e.bundle(str(tmp_path / "d.zip")).endswith("d.zip")
    other = tmp_path / "other"
    assert engine.initialise(str(other), "advanced")["ok"]
    assert not engine.initialise(str(other), "advanced")["ok"] and engine.initialise(str(other), "advanced", True)["ok"]
    (other / "m.py").write_text("q = 1\n")
    assert "q = 1" in Engine(spark, str(other)).render("ctx:work")
    with pytest.raises(EngineError):
        engine.initialise(str(other), "none")


def test_tables_are_corpora_too(spark, tree, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws("/", F.lit("pkg"), "source", F.concat("doc_id", F.lit(".py"))).alias("rel_path"), "text", F.octet_length("text").cast("bigint").alias("size_bytes"))
    out = Engine(spark, str(tree), corpus=docs).report("sec:py")
    assert len(out["files"]) == 200


def test_catalog_notices_changes(tree):
    c = sections.Catalog(str(tree))
    assert c.find("inner", "sub") == "sub/inner" and c.find("/py") == "py" and c.find("docs", "sub") == "docs"
    (tree / "context/new.sec.yaml").write_text("fresh: {filters: {mode: block}}\n")
    assert "fresh" in c.names()
    with pytest.raises(sections.SectionError):
        c.find("/none")
