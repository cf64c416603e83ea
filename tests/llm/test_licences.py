from facetframe.llm.licences import KNOWN, TEXTS, known_texts, scan_licences

DOC = "doc_id long, text string, licence string, digest int"


def test_variants_are_found(spark, odd, none):
    mit = next(t for n, t in KNOWN if n == "MIT" and "Permission" in t)
    wrapped = "\n".join(mit.replace("LICENSE", "LICENCE").split(". "))
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, "# text\n\nreleased under the m.i.t license\n\nReleased   under the\tMIT LICENCE!"),
            (3, mit.upper().replace(",", "")), (4, mit[:-30]), (5, "Licensed under CC BY-NC 4.0.\nmore text"), (6, None), (7, ""),
            (8, "Copyright 2021 X. All rights reserved."), (9, "© X\nAll rights reserved"), (5, "All rights reserved."), (10, wrapped)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)
    got = {(r.doc_id, r.licence): (r.n_units, r.entire) for r in scan_licences(docs).collect()}
    assert got[1, "MIT"][1] and got[3, "MIT"] == (1, True) and got[2, "MIT"] == (1, False) and got[10, "MIT"][1]
    assert got[5, "CC-BY-NC-4.0"] == (1, False) and got[5, "Proprietary"] == (1, True) and got[9, "Proprietary"][1]
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (5, "CC-BY-NC-4.0"), (5, "Proprietary"), (9, "Proprietary"), (10, "MIT")}
    assert scan_licences(odd).count() == 0 and scan_licences(none).count() == 0


def test_titled_licence_files_are_entire(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and "Permission" in t)
    isc = next(t for n, t in KNOWN if n == "ISC")
    files = {p.stem: p.read_text() for p in TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= set(files)
    holder = "Copyright (c) 2020, Some One\n"
    bullets = files["BSD-2-Clause"].replace("1. ", "   * ").replace("2. ", "   * ").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")
    apache = files["Apache-2.0"]
    cases = [("MIT", f"MIT License\n\n{holder}\n{mit}"), ("MIT", f"The MIT License (MIT)\n\n{holder}\n{mit}"), ("ISC", f"ISC License\n\n{holder}\n{isc}"),
             ("BSD-3-Clause", f"BSD 3-Clause License\n\n{holder}All rights reserved.\n\n{files['BSD-3-Clause']}"), ("BSD-3-Clause", holder + files["BSD-3-Clause"]),
             ("BSD-2-Clause", f"{holder}\n{bullets}"), ("Apache-2.0", apache.split("APPENDIX")[0]),
             ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Some One")), ("Unlicense", "The Unlicense\n\n" + files["Unlicense"])]
    cases += files.items()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    entire = {r.doc_id: r.licence for r in scan_licences(docs).where("entire").collect()}
    assert entire == {i: licence for i, (licence, _) in enumerate(cases)}
    assert scan_licences(docs.selectExpr("doc_id", "substring(text, 1, length(text) - 60) AS text")).where("entire").count() == 0
    assert all(t.strip() for _, t in known_texts())
