"""Path predicates and path arithmetic, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and folders of tests, samples and build files.
TEST_FILE_RE = r"(^|/)(test[_.][^/]*|[^/]*[._-](tests?|specs?)\.[a-z0-9]+)$"
TEST_FILE_CASED_RE = r"(Tests?|TestCase|Tester|Specs?)\.[A-Za-z0-9]+$|(^|/)[A-Za-z0-9]*(Tests?|Spec)/"
TEST_DIR_RE = r"(^|/)(tests?|specs?)/|/(__tests__|testlib|testing)/"
SIDE_DIR_RE = r"(^|/)(integration|examples?|samples?|benchmarks?|fixtures?|demos?)/"
#: Endings of files that tools write, by language.
GENERATED_RE = (
    r"\.pb\.go$|\.pulsar\.go$|_grpc\.pb\.go$|_mocks?\.go$|^mock_[^/]+\.go$"
    r"|\.generated\.[jt]sx?$|\.gen\.[jt]sx?$|\.pb\.[jt]s$|_pb\.[jt]s$|_grpc_pb\.[jt]s$|\.min\.m?js$"
    r"|_pb2(_grpc)?\.py$|_pb2\.pyi$|\.pb\.(cc|h)$|\.g\.cs$|Grpc\.cs$|OuterClass\.java$|Grpc\.java$"
    r"|\.pb\.swift$|\.(g|freezed|pb|pbgrpc|chopper)\.dart$|\.generated\.rs$"
)
LOW_VALUE_RE = r"(^|/)(tests?|__tests?__|spec)/|_test\.(go|py|rb|dart)$|(^|/)test_[^/]+\.py$|_spec\.rb$|\.(test|spec)\.[jt]sx?$|(test|spec|tests)\.(java|kt|scala)$|(tests?|spec)\.cs$|tests?\.swift$"


def dirname(p: Column) -> Column:
    return F.regexp_replace(p, r"/?[^/]*$", "")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def is_test(p: Column) -> Column:
    low = F.lower(p)
    return low.rlike(TEST_FILE_RE) | p.rlike(TEST_FILE_CASED_RE) | low.rlike(TEST_DIR_RE) | low.rlike(SIDE_DIR_RE)


def is_generated(p: Column) -> Column:
    return p.rlike(GENERATED_RE)


def is_low_value(p: Column) -> Column:
    return F.lower(p).rlike(LOW_VALUE_RE) | is_generated(p)


def is_build_file(p: Column) -> Column:
    """Build scripts: Gradle files, what lies in a folder of build logic, Python outside of any source folder."""
    q = F.translate(p, "\\", "/")
    folders = F.split(q, "/")
    return q.rlike(r"\.gradle(\.kts)?$") | F.array_contains(folders, "buildSrc") | F.array_contains(folders, "build-logic") | (q.endswith(".py") & ~q.contains("/src/"))


def directories(p: Column) -> Column:
    """Directory names of a path, without the file's."""
    s = F.split(p, "/")
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def ancestors(p: Column) -> Column:
    """Every directory above a path, from the outermost."""
    d = directories(p)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1))), lambda i: F.array_join(F.slice(d, 1, i), "/"))


def proximity(a: Column, b: Column) -> Column:
    """15 points for each leading directory that two paths share, at most 80."""
    x, y = directories(a), directories(b)
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    first = F.array_position(same, False)
    shared = F.when(first > 0, first - 1).otherwise(F.size(same))
    return F.least(F.lit(80), (shared * 15).cast("int"))


def glob_regex(pattern: str) -> str:
    """`**`, `*` and `?` of a file glob as an anchored regular expression."""
    import re

    out = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group(0)) or re.escape(m.group(0)), pattern)
    return f"^{out}$"
