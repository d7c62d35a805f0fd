"""The scan next to its SQL on texts that begin with a key phrase, so a notice's start lies before the first word."""

import duckdb
import pytest

from cairnmap.llm import licenses

TEXTS = ["Apache License Version 2.0, January 2004", "GNU GENERAL PUBLIC LICENSE Version 3", "GNU General Public License version 2 or later", "CC BY-NC 4.0",
         "Licensed under CC BY SA 4.0", "cc by cc by nc", "see the MIT License and the Apache license", "", "gnu general public", "license apache",
         "Redistribution and use in source and binary forms, with or without modification, are permitted", "words without any notice at all",
         "Permission is hereby granted, free of charge, to any person", "public license " * 50 + "Mozilla Public License", None, *["plain words"] * 60]


def test_scan_equals_its_sql(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r.doc_id: tuple(r) for r in licenses.scan_licenses(docs).select(columns).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = con.execute(licenses.oracle())
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    wanted = {r[at[0]]: tuple(r[i] for i in at) for r in cursor.fetchall()}
    assert got.keys() == wanted.keys()
    for i in got:
        assert got[i][:-1] == wanted[i][:-1] and got[i][-1] == pytest.approx(wanted[i][-1], abs=2e-6)
    found = {label for r in got.values() for label in r[6].split(",")}
    assert {"apache", "gpl", "cc-by", "mit", "cc-by-sa", "bsd", "mpl"} <= found and found & {"apache-2.0", "gpl-2.0", "gpl-3.0", "cc-by-nc"}
