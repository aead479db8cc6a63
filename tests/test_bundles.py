"""Bundle rules: a sound bundle breaks none, and each planted fault breaks its own."""

import pytest

from skyvane.operators import bundles as b

FORMATS = {"manifest": "MANIFEST 1", "grouping": "EPISODES 1", "features": "FEATURES 1"}
SCHEMAS = {
    "heads": "capture string, source string, format string, capture_id string, file_count bigint, episode_count bigint, gap_s double, comparison string, sample_rate_hz int, iq_dtype string",
    "files": "capture string, position int, path string, size_bytes bigint, sha256 string", "members": "capture string, episode int, position int, path string, size_bytes bigint, sha256 string, mtime_ns bigint",
    "episodes": "capture string, episode int, file_count bigint, fragment_count bigint", "fragments": "capture string, episode int, position int, path string, size_bytes bigint, samples bigint",
    "hashes": "capture string, position int, line string", "disk": "path string, size_bytes bigint, sha256 string",
}


def bundle(c):
    files = [(c, i, f"{c}/{i}.iq", 160 * (i + 1), f"{c}{i:02d}") for i in range(5)]
    place = [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    head = lambda s, n, e, *x: [c, s, FORMATS[s], c, n, e, *x]
    return {
        "heads": [head("manifest", 5, None, None, None, None, None), head("grouping", 5, 2, 4.0, ">", None, None), head("features", None, 2, None, None, 25000, "complex128")],
        "files": [list(f) for f in files], "members": [[c, e, k, f[2], f[3], f[4], 10**9 + f[1]] for f, (e, k) in zip(files, place)],
        "episodes": [[c, 1, 2, 2], [c, 2, 3, 3]], "fragments": [[c, e, k, f[2], f[3], f[3] // 16] for f, (e, k) in zip(files, place)],
        "hashes": [[c, f[1], f"{f[4]}  {f[2]}"] for f in files], "disk": [[f[2], f[3], f[4]] for f in files],
    }


def put(table, row, column, value):
    def change(x):
        x[table][row][column] = value

    return change


def drop(table, row):
    return lambda x: x[table].pop(row)


FAULTS = {
    "format": (put("heads", 0, 2, "OLD"), ["format"]), "no head": (drop("heads", 2), ["head missing", "episode count"]), "two heads": (lambda x: x["heads"].append(list(x["heads"][0])), ["head missing"]),
    "id": (put("heads", 1, 3, "other"), ["capture id"]), "gap": (put("heads", 1, 6, 3.0), ["grouping parameters"]), "comparison": (put("heads", 1, 7, None), ["grouping parameters"]), "rate": (put("heads", 2, 8, 24000), ["sample parameters"]),
    "dtype": (put("heads", 2, 9, "complex64"), ["sample parameters"]), "count": (put("heads", 0, 4, 6), ["manifest count"]), "no count": (put("heads", 0, 4, None), ["manifest count"]), "grouped count": (put("heads", 1, 4, 4), ["grouping file count"]),
    "time": (put("members", 3, 6, None), ["recorded time missing"]), "size": (put("members", 0, 4, 161), ["grouping size or hash", "fragment size", "fragment samples"]), "hash": (put("members", 0, 5, "x"), ["grouping size or hash"]),
    "episodes": (put("heads", 1, 5, 3), ["episode count"]), "feature episodes": (put("heads", 2, 5, 1), ["episode count"]), "files of one": (put("episodes", 0, 2, 3), ["episode file count"]), "fragments of one": (put("episodes", 1, 3, None), ["episode fragment count"]),
    "fragment path": (put("fragments", 4, 3, "q"), ["features membership or order"]), "fragment": (drop("fragments", 1), ["features membership or order"]), "fragment size": (put("fragments", 2, 4, 1), ["fragment size"]), "samples": (put("fragments", 2, 5, 31), ["fragment samples"]),
    "line": (put("hashes", 2, 2, "x  y"), ["hash list"]), "no line": (drop("hashes", 4), ["hash list"]), "more lines": (lambda x: x["hashes"].append(["C", 5, ""]), ["hash list"]), "raw": (drop("disk", 1), ["raw file missing"]), "raw size": (put("disk", 1, 1, 16), ["raw size"]),
    "raw hash": (put("disk", 1, 2, None), ["raw hash"]), "raw partial": (lambda x: [put("disk", 1, 1, 321)(x), put("files", 1, 3, 321)(x), put("members", 1, 4, 321)(x), put("fragments", 1, 4, 321)(x)], ["fragment samples", "raw size is no whole number of samples"]),
    "twice in manifest": (lambda x: x["files"].append(list(x["files"][0])), ["repeated manifest path", "manifest count"]), "twice grouped": (lambda x: x["members"].append([*x["members"][0][:1], 3, 0, *x["members"][0][3:]]), ["grouping omits or repeats a file", "grouping file count", "episode numbers", "episode file count", "episode fragment count", "features membership or order"]),
    "omitted": (lambda x: [drop("members", 4)(x), drop("fragments", 4)(x), put("episodes", 1, 2, 2)(x), put("episodes", 1, 3, 2)(x), put("heads", 1, 4, 4)(x)], ["grouping omits or repeats a file"]),
    "numbers": (lambda x: [put(t, i, 1, 3)(x) for t in ("episodes", "members", "fragments") for i, r in enumerate(x[t]) if r[1] == 2], ["episode numbers"]),
}


def test_each_fault_breaks_its_rule(spark):
    rows, want = {t: [] for t in SCHEMAS}, {"sound": [], "also": []}
    for name in [*want, *FAULTS]:
        x = bundle(name)
        if name in FAULTS:
            change, want[name] = FAULTS[name]
            change(x)
        for t, r in x.items():
            rows[t] += [[name if v == "C" else v for v in row] for row in r]
    rows["heads"].append([None] * 10)
    got = b.bundle_problems(*[spark.createDataFrame(rows[t], s) for t, s in SCHEMAS.items()], FORMATS)
    assert {r.capture: r.problems for r in got.collect()} == want
    assert {p for ps in want.values() for p in ps} == {r for r, _ in b.RULES}


def test_nothing(spark):
    assert b.bundle_problems(*[spark.createDataFrame([], s) for s in SCHEMAS.values()], FORMATS).count() == 0
