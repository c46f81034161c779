"""``python -m loomtext render|report|list|diag|init``."""

from __future__ import annotations

import argparse
import json
import sys

from loomtext.functions import tokens
from loomtext.plans import engine, sections


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomtext")
    p.add_argument("--root", default=".")
    p.add_argument("--config-dir", default=sections.CONFIG_DIR)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("render", "report"):
        v = verbs.add_parser(verb)
        v.add_argument("target")
        v.add_argument("--mode", action="append", default=[], metavar="SET:MODE")
        v.add_argument("--tags", default="")
        v.add_argument("--task")
        v.add_argument("--provider")
        v.add_argument("--target-branch")
        v.add_argument("--lib", choices=sorted(tokens.LIBRARIES))
        v.add_argument("--encoder", default="")
        v.add_argument("--ctx-limit", type=int, default=128_000)
    v = verbs.add_parser("list")
    v.add_argument("what", choices="sections contexts mode-sets tag-sets tokenizer-libs encoders".split())
    v.add_argument("--context")
    v.add_argument("--provider")
    v.add_argument("--lib")
    v.add_argument("--folder", default=".")
    v = verbs.add_parser("diag")
    v.add_argument("--bundle")
    v = verbs.add_parser("init")
    v.add_argument("--preset", default="basic")
    v.add_argument("--force", action="store_true")
    return p


def listed(a, make) -> object:
    if a.what == "tokenizer-libs":
        return tokens.libraries()
    if a.what == "encoders":
        return tokens.encoders(a.lib or "", a.folder)
    e = make()
    if a.what == "sections":
        return e.list_sections(a.context)
    if a.what == "contexts":
        return e.list_contexts(a.provider)
    if not a.context:
        raise engine.EngineError(f"{a.what} needs --context")
    rows = e.list_mode_sets(a.context, a.provider or "clipboard") if a.what == "mode-sets" else e.list_tag_sets(a.context)
    return [r.asDict() for r in rows.collect()]


def main(words: list[str] | None = None) -> int:
    a = parser().parse_args(words)

    def make(options: engine.Options = engine.Options()) -> engine.Engine:
        from loomtext.session import local_session

        return engine.Engine(local_session(), a.root, options, a.config_dir)

    try:
        if a.verb == "init":
            out = engine.initialise(a.root, a.preset, a.force, a.config_dir)
        elif a.verb == "list":
            out = listed(a, make)
        elif a.verb == "diag":
            e = make()
            out = {"bundle": e.bundle(a.bundle)} if a.bundle else e.diagnose()
        else:
            if bad := [m for m in a.mode if m.count(":") != 1]:
                raise engine.EngineError(f"a mode is set:mode, not {bad[0]!r}")
            options = engine.Options(
                dict(m.split(":") for m in a.mode), frozenset(t for t in a.tags.split(",") if t), engine.task_text(a.task), a.provider, a.target_branch, a.lib, a.encoder, a.ctx_limit
            )
            if a.verb == "render":
                sys.stdout.write(make(options).render(a.target))
                return 0
            out = make(options).report(a.target)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
