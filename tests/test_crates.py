"""Rust modules and paths on a small workspace, with results worked out by hand."""

from arborlens.operators import crates as C


def test_use_trees():
    assert C.use_paths("self::port as harbour") == ["self::port"]
    assert C.use_paths("crate::fleet::{Ship, crew::{self, Mate, Cook as Chef}, cargo::*}") == ["crate::fleet::Ship", "crate::fleet::crew", "crate::fleet::crew::Mate", "crate::fleet::crew::Cook", "crate::fleet::cargo"]
    assert C.use_paths("super::{super::{tide, moon as night}, wind}") == ["super::super::tide", "super::super::moon", "super::wind"]
    assert C.use_paths("core::fmt") == [] and C.use_paths("core::fmt::{Debug, Display}") == []
    for bad in ("crate::{a, b", "crate::{a,,b}", "crate::{}", "crate::a b", "crate::", "crate{a}", "", None, "crate::{a} x"):
        assert C.use_paths(bad) == [], bad


def test_cargo_texts():
    text = '[package] # c\nname = "my-crate"\n\n[workspace]\nmembers = [\n  "a", # one\n  "b",\n]\nexclude = ["x"]\n[lib]\npath = "src/top.rs"\n[dependencies]\nserde = "1"\nother-one = { path = "../other", version = "1" }\n[build-dependencies]\ngen = { path = "../gen", optional = true }\n'
    assert C.cargo(text) == {"name": "my-crate", "lib": "src/top.rs", "members": ["a", "b"], "exclude": ["x"], "dependencies": [("other_one", "../other", "normal", False), ("gen", "../gen", "build", True)]}
    assert C.cargo(None)["name"] == "" and C.cargo("# only\n")["members"] == []


def test_modules_and_paths(spark):
    files = ["a/src/lib.rs", "a/src/net.rs", "a/src/net/tcp.rs", "a/src/io/mod.rs", "a/src/both.rs", "a/src/both/mod.rs", "a/src/gen/odd.rs", "b/src/lib.rs", "b/src/use_a.rs", "a/src/loose.rs"]
    f = spark.createDataFrame([("r", p, "") for p in files] + [("r", "a/Cargo.toml", '[package]\nname = "crate-a"\n'), ("r", "b/Cargo.toml", '[package]\nname = "b"\n')], "root string, path string, content string")
    packages = C.crates(f)
    assert {(x["crate"], x["lib"]) for x in packages.collect()} == {("crate_a", "a/src/lib.rs"), ("b", "b/src/lib.rs")}
    decl = [("a/src/lib.rs", "net", None), ("a/src/lib.rs", "io", None), ("a/src/lib.rs", "both", None), ("a/src/lib.rs", "odd", "gen/odd.rs"), ("a/src/lib.rs", "gone", None), ("a/src/net.rs", "tcp", None), ("b/src/lib.rs", "use_a", None)]
    tree = C.module_tree(packages.selectExpr("root", "lib as top"), spark.createDataFrame([("r", *d) for d in decl], "root string, file string, name string, explicit string"), f)
    assert {(x["file"], x["parent"]) for x in tree.collect()} == {
        ("a/src/lib.rs", None), ("a/src/net.rs", "a/src/lib.rs"), ("a/src/net/tcp.rs", "a/src/net.rs"), ("a/src/io/mod.rs", "a/src/lib.rs"), ("a/src/gen/odd.rs", "a/src/lib.rs"), ("b/src/lib.rs", None), ("b/src/use_a.rs", "b/src/lib.rs"),
    }
    tcp, use_a = "a/src/net/tcp.rs", "b/src/use_a.rs"
    asked = [
        (tcp, "crate::io::Read", "a/src/io/mod.rs"), (tcp, "super::Socket", None), (tcp, "super::super::odd::X", "a/src/gen/odd.rs"), ("a/src/net.rs", "self::tcp::Stream", tcp), ("a/src/net.rs", "self::Nothing", None), (use_a, "crate_a::net::tcp::Stream", tcp),
        (use_a, "crate_a::Thing", "a/src/lib.rs"), (use_a, "serde::Serialize", None), (use_a, "alone", None), ("a/src/net.rs", "tcp::Stream", tcp), ("a/src/loose.rs", "crate::io::X", None), ("a/src/lib.rs", "crate::Own", None), (tcp, "crate::both::X", "a/src/lib.rs"),
    ]
    got = C.walk(spark.createDataFrame([("r", s, p) for s, p, _ in asked], "root string, src string, path string"), tree, packages)
    assert {(x["src"], x["path"], x["dst"]) for x in got.collect()} == {a for a in asked if a[2]}


def test_a_module_at_two_places_leads_nowhere(spark):
    f = spark.createDataFrame([("r", p) for p in ("src/lib.rs", "src/main.rs", "src/x.rs")], "root string, path string")
    decl = spark.createDataFrame([("r", t, "x", None) for t in ("src/lib.rs", "src/main.rs")], "root string, file string, name string, explicit string")
    tree = C.module_tree(spark.createDataFrame([("r", "src/lib.rs"), ("r", "src/main.rs")], "root string, top string"), decl, f)
    assert {x["file"] for x in tree.collect()} == {"src/lib.rs", "src/main.rs"}
