import os

from callgrain.sources import page_api as P

NAMES = ["id", "text"]


def page(folder, offset, rows, body=None):
    os.makedirs(f"{folder}/offset={offset}", exist_ok=True)
    text = body if body is not None else "id,text\n" + "".join(f'{i},"a, {i}"\n' for i in rows)
    with open(f"{folder}/offset={offset}/p.csv", "w") as f:
        f.write(text)


def ids(spark, out):
    return sorted((int(r["id"]), r["page_offset"]) for r in P.loaded_pages(spark, out).collect())


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    folder, out, check = f"{tmp_path}/api", f"{tmp_path}/out", f"{tmp_path}/check"
    api = P.FolderApi(folder, 10)
    for o in (0, 10):
        page(folder, o, range(o, o + 10))
    page(folder, 20, [], '{"error": "limit, reached"}\n')
    page(folder, 30, range(30, 35))
    P.load_pages(spark, api, NAMES, out, check)
    assert ids(spark, out) == [(i, i // 10 * 10) for i in range(20)]
    P.load_pages(spark, api, NAMES, out, check)  # the error page is still there: no step forward
    assert len(ids(spark, out)) == 20
    page(folder, 20, range(20, 30))
    P.load_pages(spark, api, NAMES, out, check)
    assert ids(spark, out) == [(i, i // 10 * 10) for i in range(35)]
    P.load_pages(spark, api, NAMES, out, check)
    assert len(ids(spark, out)) == 35


def test_batches_are_bounded(spark, tmp_path):
    folder, out, check = f"{tmp_path}/api", f"{tmp_path}/out", f"{tmp_path}/check"
    for o in range(0, 50, 10):
        page(folder, o, range(o, o + 10))
    P.load_pages(spark, P.FolderApi(folder, 10), NAMES, out, check, most=2)
    assert ids(spark, out) == [(i, i // 10 * 10) for i in range(50)]
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 3


def test_rows_of_the_wrong_length_and_statuses(tmp_path):
    folder = f"{tmp_path}/api"
    page(folder, 0, [], "id,text\n1,a\n2\n3,b,c\n4,\n")
    api = P.FolderApi(f"file://{folder}", 10)
    assert (api.status(0), api.status(10)) == (P.READY, P.MISSING)
    reader = P._Reader(api, NAMES, 0, 5)
    assert reader.latestOffset() == {"offset": 10}
    assert list(reader.read(reader.partitions({"offset": 0}, {"offset": 10})[0])) == [("1", "a", 0), ("4", None, 0)]
