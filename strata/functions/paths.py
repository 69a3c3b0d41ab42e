"""Column expressions over repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.vocab import CONFIG_NAMES, IGNORED_DIRS, SCAN_SUFFIXES


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def backslashed(path: Column) -> Column:
    """Lower-cased with backslashes: how claims and chunks name files."""
    return F.lower(F.translate(path, "/", "\\"))


def parts(path: Column) -> Column:
    return F.split(posix(path), "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the name with its dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """Name without its last suffix."""
    name = file_name(path)
    return F.when(suffix(path) == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path))))


def is_relevant(path: Column) -> Column:
    return F.coalesce(suffix(path).isin(SCAN_SUFFIXES) & ~F.arrays_overlap(parts(path), F.array(*map(F.lit, IGNORED_DIRS))), F.lit(False))


def _named_as_test(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.startswith("test_") | name.endswith("_test.py")


def is_test_file(path: Column) -> Column:
    return F.array_contains(parts(F.lower(path)), "tests") | _named_as_test(path)


def layer(path: Column) -> Column:
    """Layer by the first rule that fits."""
    low, kind = parts(F.lower(path)), suffix(path)
    return (
        F.when(is_test_file(path), "test")
        .when(F.array_contains(low, "docs") | kind.isin(".md", ".txt"), "documentation")
        .when(F.lower(file_name(path)).isin(CONFIG_NAMES), "configuration")
        .when(F.array_contains(low, "src") | (kind == ".py"), "source")
        .otherwise("other")
    )


def code_class(path: Column) -> Column:
    return F.when(is_test_file(path), "test").otherwise("production")


def retrieval_role(path: Column) -> Column:
    """Role in ranking: a directory named test counts here, one named tests does not."""
    low = parts(F.lower(path))
    is_test = F.exists(low, lambda p: (p == "test") | p.startswith("test_") | p.endswith("_test.py"))
    return F.when(is_test, "test").when(F.arrays_overlap(low, F.array(F.lit("src"), F.lit("lib"), F.lit("app"))), "production").otherwise("neutral")


def module_name(path: Column) -> Column:
    """Dotted name: without a leading src, the suffix, and a last __init__."""
    bare = F.regexp_replace(F.regexp_replace(posix(path), r"\.py$", ""), "^src/", "")
    return F.translate(F.regexp_replace(bare, "/__init__$", ""), "/", ".")


def test_candidates(path: Column) -> Column:
    """Lower-case paths where a module's test may lie, sorted; directories behind the first src name the package."""
    low = parts(F.lower(path))
    at = F.array_position(low, "src").cast("int")
    dirs = F.slice(low, at + 1, F.greatest(F.size(low) - at - 1, F.lit(0)))
    package, own = F.array_join(dirs, "_"), F.lower(stem(path))
    names = F.when(
        (at > 0) & (package != ""),
        F.array(F.concat(F.lit("tests/test_"), own, F.lit(".py")), F.concat(F.lit("tests/test_"), package, F.lit("_"), own, F.lit(".py")), F.concat(F.lit("tests/test_"), package, F.lit(".py"))),
    ).otherwise(F.array(F.concat(F.lit("tests/test_"), own, F.lit(".py"))))
    return F.sort_array(F.array_distinct(names))


def ellipsis_middle(path: Column, limit: int = 42) -> Column:
    """Long paths keep their tail behind an ellipsis."""
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(limit - 1))))


def ellipsis_tail(label: Column, limit: int = 23) -> Column:
    return F.when(F.length(label) <= limit, label).otherwise(F.concat(F.left(label, F.lit(limit - 1)), F.lit("…")))


def snapshot_time(path: Column) -> Column:
    """Time in a name like snapshot_20260930_172930.json; null for other names."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(file_name(path), r"^snapshot_(\d{8}_\d{6})\.json$", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def valid_clone_url(url: Column) -> Column:
    """https on github.com with an owner and a repository, or a path that ends in .git."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == "github.com")
    return F.coalesce(ok & (path.endswith(".git") | path.rlike("^[^/]+/[^/]+$")), F.lit(False))


def valid_repository_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9._-]+$") & ~name.isin(".", ".."), F.lit(False))
