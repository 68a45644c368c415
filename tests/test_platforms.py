"""Build constraints against a truth table of their own, and the forms that constraints and names have."""

import itertools
import random

import pytest

from loupe.operators import platforms


def expression(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        return r.choice(["linux", "windows", "darwin", "unix", "amd64", "arm64", "cgo", "integration", "go1.20"])
    kind = r.choice(["!", "&&", "||", "()"])
    if kind == "!":
        return f"!({expression(r, depth + 1)})"
    return f"({expression(r, depth + 1)})" if kind == "()" else f"{expression(r, depth + 1)} {kind} {expression(r, depth + 1)}"


@pytest.mark.parametrize("seed", range(3))
def test_truth_table(seed):
    r = random.Random(seed)
    for _ in range(150):
        text = expression(r)
        python = text.replace("&&", " and ").replace("||", " or ").replace("!", " not ").replace("go1.20", "go1_20")
        names = sorted({"go1_20" if t == "go1.20" else t for t in platforms._TAG.findall(text)})
        post = platforms.postfix(f"//go:build {text}\n\npackage x")
        for platform in [None, ("linux", "amd64"), ("android", "arm64"), ("windows", "386")]:
            choices = [(True, False) if platform is None or (v := platforms._holds(n, *platform)) is None else (v,) for n in names]
            want = any(eval(python, {}, dict(zip(names, row))) for row in itertools.product(*choices))
            assert platforms.satisfiable(post, platform) == want, text


@pytest.mark.parametrize(("text", "want"), [
    ("//go:build linux && !cgo\n\npackage x", "linux cgo ! &&"), ("//go:build a || b && c\n\npackage x", "a b c && ||"), ("//go:build (a || b) && c\n\npackage x", "a b || c &&"), ("//go:build !!a\n\npackage x", None), ("//go:build a b\n\npackage x", None), ("//go:build (a\n\npackage x", None),
    ("//go:build a)\n\npackage x", None), ("//go:build &&\n\npackage x", None), ("//go:build a\npackage x", None), ("//go:buildx a\n\npackage x", None), ("package x\n//go:build a\n\n", None), ("/* c\n*/\n// +build a,!b c\n// +build d\n\npackage x", "a b ! && c || d &&"), ("// +build !!a\n\npackage x", "ignore"),
    ("/* c */ package x\n//go:build a\n\n", "a"), ("// +build\n\npackage x", "ignore"), ("// c\n\n//go:build a\n\n// doc\npackage x", "a"), ("", None), ("/* never closed\n//go:build a\n\n", None), ("//go:build " + "(" * 500 + "a" + ")" * 500 + "\n\npackage x", "a"),
])
def test_forms(text, want):
    assert platforms.postfix(text) == want


def test_built_on(spark):
    many = " && ".join(f"t{i}" for i in range(13))
    rows = [
        ("a/x_linux.go", "", "linux", "amd64", True), ("a/x_linux.go", "", "android", "arm64", True), ("a/x_linux.go", "", "darwin", "arm64", False), ("a/x_windows_amd64_test.go", "", "windows", "amd64", True), ("a/x_windows_amd64_test.go", "", "windows", "arm64", False),
        ("a/linux.go", "", "darwin", "arm64", True), ("linux_x/y.go", "", "darwin", "arm64", True), ("x_amd64.go", "", "linux", "arm64", False), ("x_linux_y.go", "", "darwin", "arm64", True), ("x_test.go", "", "darwin", "arm64", True), ("x_darwin.go", "", "ios", "arm64", True), ("x_a.b_linux.go", "", "darwin", "arm64", True),
        ("a.go", "//go:build linux\n\npackage a", "darwin", "arm64", False), ("a.go", "//go:build integration\n\npackage a", "darwin", "arm64", True), ("a.go", "//go:build integration && !integration\n\npackage a", "darwin", "arm64", True), ("a.go", "//go:build linux && windows\n\npackage a", "linux", "amd64", False),
        ("a.go", "//go:build unix\n\npackage a", "windows", "amd64", False), ("a.go", f"//go:build windows && {many}\n\npackage a", "linux", "amd64", True), ("a.go", None, "linux", "amd64", True), ("a_windows.go", "//go:build linux\n\npackage a", None, None, True), (None, None, "linux", "amd64", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, file string, text string, system string, architecture string, want boolean")
    got = platforms.built_on(df)
    assert [r["id"] for r in got.where("built <> want OR built IS NULL").collect()] == [] and got.count() == len(rows)
