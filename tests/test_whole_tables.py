"""Queries over awkward tables, against Python: what their SQL does not express, or local tables do not hold."""

import hashlib
import html
import re
import unicodedata

import pytest

from sluicegate.plans import catalog

SF = "/root/testdata/sf0.001"
ODD = [None, "", "Ｉｇｎｏｒｅ\u200b ALL &amp; &lt;b&gt;", "Straße\u00adnbahn  \u2003İstanbul ﬁn", "plain  TEXT\tonly", "&#x41;&#66; caf\u0065\u0301", "e\ufeffs ist\u2060 gut"]


def canonical(text):
    seen = unicodedata.normalize("NFKC", html.unescape(text or ""))
    hidden = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
    return re.sub(r"\s+", " ", seen.translate(dict.fromkeys(hidden)).lower())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000 + k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD)], docs.schema)
    path = str(tmp_path_factory.mktemp("whole"))
    docs.union(odd).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path, {r.doc_id: r.text for r in docs.union(odd).select("doc_id", "text").collect()}


def test_canonical_surface_of_all_documents(spark, table):
    path, texts = table
    got = {r.doc_id: r.canonical_sha256 for r in catalog.queries()["canonical_surface"](spark, path).collect()}
    assert got == {k: hashlib.sha256(canonical(t).encode()).hexdigest() for k, t in texts.items()}


def test_hidden_payloads_are_found_in_whole_texts(spark, table):
    path, texts = table
    got = {(r.ordinal, r.family) for r in catalog.queries()["obfuscated_hits"](spark, path).collect()}
    assert {(k, f) for k in texts if (f := catalog._HIDDEN[k % 6][1])} == {x for x in got if x[1] == "instruction_override"}


def test_trigger_components_of_all_parts(spark, tmp_path):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    odd = spark.createDataFrame([(9000, None, "b", "t", 1, 1.0), (9001, " ", "b", "t", 1, 1.0), (9002, "Far  gadget", "b", "t", 1, 1.0), (9003, "gadget", "b", "t", 1, 1.0), (None, "gadget", "b", "t", 1, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size long, p_retailprice double")
    table = parts.select(*(parts[c].cast(t) for c, t in odd.dtypes)).union(odd)
    table.write.parquet(f"{tmp_path}/part.parquet")
    rows = [r for r in table.collect() if r.p_partkey is not None]
    least = {r.p_partkey: r.p_partkey for r in rows}
    words = [(r.p_partkey, (r.p_brand, r.p_type, r.p_size, w)) for r in rows for w in (r.p_name or "").lower().split()]
    while True:
        of_word = {}
        for k, w in words:
            of_word[w] = min(of_word.get(w, least[k]), least[k])
        new = least | {k: min(of_word[w] for j, w in words if j == k) for k, _ in words}
        if new == least:
            break
        least = new
    got = {r["item"]: r["component"] for r in catalog.queries()["trigger_components"](spark, str(tmp_path)).collect()}
    assert got == least and len(got) == parts.count() + 4
