"""Ignore rules as a join against a matcher in memory."""

from __future__ import annotations

import fnmatch
import random

import pytest

from tesserae.sources import ignore


class Ignore:
    """Ignore rules by directory (B09, B10): the last rule that matches wins, and below an ignored directory nothing is kept."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        """rules: (directory, line) in order of their files; outer directories come first."""
        self.rules = [(d.strip("/"), *self._parsed(line)) for d, line in rules if line.strip() and not line.startswith("#")]

    @staticmethod
    def _parsed(line: str) -> tuple[str, bool, bool, bool]:
        line = line.rstrip("\r\n")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        line = line.replace("\\ ", " ")
        negated = line.startswith("!")
        line = line[negated:]
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        only_dir = line.endswith("/")
        line = line.rstrip("/") if only_dir else line
        return line.lstrip("/"), negated, only_dir, "/" in line

    @staticmethod
    def _matches(pattern: list[str], path: list[str]) -> bool:
        if not pattern:
            return not path
        if pattern[0] == "**":
            return (len(pattern) == 1 and bool(path)) or any(Ignore._matches(pattern[1:], path[i:]) for i in range(len(path) + 1))
        return bool(path) and fnmatch.fnmatchcase(path[0], pattern[0]) and Ignore._matches(pattern[1:], path[1:])

    def _exact(self, path: list[str], is_dir: bool) -> bool:
        ignored = False
        for base, pattern, negated, only_dir, anchored in self.rules:
            root = base.split("/") if base else []
            if path[: len(root)] != root or len(path) == len(root) or (only_dir and not is_dir):
                continue
            rest = path[len(root) :]
            if self._matches(pattern.split("/"), rest) if anchored else fnmatch.fnmatchcase(rest[-1], pattern):
                ignored = not negated
        return ignored

    def match(self, path: str, is_dir: bool = False) -> bool:
        steps = [s for s in path.split("/") if s]
        return any(self._exact(steps[: i + 1], is_dir or i + 1 < len(steps)) for i in range(len(steps)))


def kept(spark, paths, *rule_files):
    """Files that stay; rule_files: (directory, text)."""
    listing = spark.createDataFrame([(f"{d}/.gitignore".lstrip("/"), t) for d, t in rule_files] or [("none", "")], "path string, text string")
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in ignore.kept(files, ignore.rules(listing)).collect()}


def test_trailing_spaces():
    for line, want in (("plain   ", "plain"), ("escaped\\  ", "escaped\\ "), ("even\\\\ ", "even\\\\"), ("odd\\\\\\ ", "odd\\\\\\ ")):
        assert ignore.trimmed(line) == want


CASES = [
    ("parents must come back in", [("", "*\n!.local/\n!.local/share/\n!.local/share/keep.txt\n")], {".local/share/keep.txt": True, ".local/share/containers/locked": False, "other/keep.txt": False}),
    ("what isn't a pattern is passed over", [("", "[\nfuture-ignore-format::value\nignored/\n")], {"ignored/file.txt": False, "unrelated.txt": True}),
    ("a directory comes back", [("", "restored/\n!restored/\n")], {"restored/nested/file.txt": True}),
    ("rules stay below their base", [("a", "*.secret\n"), ("b", "!file.secret\n")], {"a/file.secret": False, "b/file.secret": True, "file.secret": True}),
    ("an escaped space before padding", [("", "secret\\  \n")], {"secret ": False, "secret": True}),
    ("allowed files", [("", "*\n!.gitignore\n!allowed/\n!allowed/wanted.txt   \n!allowed/space\\ \n!plain\n!plain/wanted.txt\n")],
     {"allowed/space ": True, "allowed/wanted.txt": True, "allowed/ignored.txt": False, "ignored/deep.txt": False, "plain/plain": True, "plain/wanted.txt": True, "plain/ignored.txt": False}),
    ("wildcards", [("", "*.log\n!keep.log\nbuild/\n!build/x\n/top.txt\na/**/z\n**/deep/f?o\nd/**\nx[0-9].c\ny[!a].c\n\\#hash\n\\!bang\n*.tar.gz\nw*d\n"), ("sub", "*.tmp\nin/*.c")],
     {"x.log": False, "keep.log": True, "build/x": False, "top.txt": False, "d2/top.txt": True, "sub/q.tmp": False, "q.tmp": True, "a/b/c/z": False, "a/z": False, "q/deep/foo": False, "deep/fo": True, "d/e": False,
      "x1.c": False, "xx.c": True, "ya.c": True, "yb.c": False, "#hash": False, "!bang": False, "q.tar.gz": False, "q.gz": True, "word": False, "sub/in/a.c": False, "in/a.c": True, "sub/in/b/a.c": True}),
    ("an inner rule goes before an outer one", [("", "*.x\n"), ("p", "!k.x\n"), ("p/q", "k.x\n")], {"k.x": False, "p/k.x": True, "p/q/k.x": False, "p/r/k.x": True}),
    ("none", [], {"a": True}),
]


@pytest.mark.parametrize(("rule_files", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_cases(spark, rule_files, want):
    assert kept(spark, want, *rule_files) == {p for p, stays in want.items() if stays}


def test_many(spark):
    """100,000 paths under 5,000 rules of all kinds in many directories, against the matcher on a part of them."""
    r = random.Random(3)
    paths = [f"d{i % 40}/e{i % 300}/f{i}.{r.choice(['go', 'log', 'tmp', 'c'])}" for i in range(100_000)]
    kinds = [lambda: f"f{r.randrange(100_000)}.go", lambda: f"/d{r.randrange(40)}/e{r.randrange(300)}/f{r.randrange(100_000)}.c", lambda: f"d{r.randrange(40)}/**/f{r.randrange(100)}*.log", lambda: f"!f{r.randrange(100_000)}.log", lambda: f"e{r.randrange(3000)}/"]
    lines = {"": [r.choice(kinds)() for _ in range(4_000)] + ["*.tmp", "f?.*"]}
    for i in range(40):
        lines[f"d{i}"] = [f"e{r.randrange(300)}/f{r.randrange(1000)}*" for _ in range(24)] + [f"!*{i}.tmp"]
    got = kept(spark, paths, *((d, "\n".join(x)) for d, x in lines.items()))
    some = r.sample(paths, 60)
    for p in some:
        own = [(d, x) for d in ("", p.split("/")[0]) for x in lines[d]]
        assert (p in got) == (not Ignore(own).match(p)), p
    assert 1_000 < len(got) < 99_000
