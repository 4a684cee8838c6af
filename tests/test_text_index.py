import random

import pytest
from callgrain.operators import explore
from callgrain.sources import text_index as T

COLS = ("QueryText", "KccAns")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("index"))
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeghilnorst") for _ in range(rng.randrange(2, 7)))
    rows = [(i, i // 50, " ".join(word() for _ in range(6)), " ".join(word() for _ in range(4)) if i % 5 else None) for i in range(800)]
    rows += [(1000, 3, "Straße ΟΔΟΣ ﬁne", "Kelvin"), (1001, 7, "İstanbul", "ſecret zebra"), (1002, 9, None, "a.b zebraX"), (1003, 11, "co|or colour", "")]
    df = spark.createDataFrame(rows, "id int, part int, QueryText string, KccAns string")
    df.repartition("part").write.partitionBy("part").parquet(f"{base}/table")
    T.build_index(spark, f"{base}/table", f"{base}/grams", COLS)
    return base


def test_equals_the_plain_search(spark, stored):
    whole = spark.read.parquet(f"{stored}/table")
    for term, regex in (
        ("zebra", True), ("ZEBRA", False), ("strasse|straße", True), ("οδος", True), ("kelvin", True), ("istanbul", True), ("secret", True),
        ("zeb[a-r]a", True), ("colou?r", True), ("co|or", False), ("a.b", False), ("a.b", True), ("ab", True), ("^zeb", True), ("bra$", True),
        ("(zeb|nothing)ra", True), ("zebra+x", True), ("qqq|zebra", True), ("qqqq", True), ("z{1}ebra", True), ("\\w+ebra", True), ("tion.", False), ("  ", True),
    ):
        got = T.search(spark, f"{stored}/table", f"{stored}/grams", term, COLS, regex)
        want = explore.facet_filter(whole, search=term, regex=regex, text_cols=COLS)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), term


def test_files_are_not_read(spark, stored):
    files = T.candidate_files(spark, f"{stored}/grams", "zebra")
    total = len(spark.read.parquet(f"{stored}/table").inputFiles())
    assert len(files) == 2 < total / 4
    read = T.search(spark, f"{stored}/table", f"{stored}/grams", "zebra", COLS).inputFiles()
    assert len(read) == 2
    assert T.candidate_files(spark, f"{stored}/grams", "qqqq") == [] and T.candidate_files(spark, f"{stored}/grams", "z.b") is None


def test_needed_runs():
    assert T.needed_runs("abc[de]fgh|xyz+") == [["abc", "fgh"], ["xyz", ""]]
    assert T.needed_runs("colou?r") == [["colo", "", "r"]]
    assert T.needed_runs("a(bc)*") is None and T.needed_runs("x[[a]b]") is None
