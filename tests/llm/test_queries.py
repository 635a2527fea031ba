"""Registered queries on the given tables: SQL where there is some, else brute force."""

import hashlib
from collections import Counter

import duckdb
import pytest

from specflow.llm import queries
from specflow.session import table

from .test_secrets import brute as brute_secrets
from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns == COLUMNS[name]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = Counter(map(tuple, db.execute(f"SELECT {', '.join(COLUMNS[name])} FROM ({queries.SQL[name]})").fetchall()))
    assert Counter(map(tuple, queries.QUERIES[name](spark, SF).collect())) == want


def test_secrets_digest(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in queries.op7_secrets(spark, SF).collect():
        spans = brute_secrets(texts[r["doc_id"]])
        spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == [s for s in spelled.split(",") if s]


def test_simhash_digest(spark):
    docs = table(spark, SF, "documents").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs}
    of = brute_components(set(prints.values()))
    least = {}
    for id, p in prints.items():
        least[of[p]] = min(id, least.get(of[p], id))
    want = {id: (f"{p:016x}", least[of[p]]) for id, p in prints.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()} == want
