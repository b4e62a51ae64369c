"""Queries against their twins on pages that the smallest tables lack."""

import duckdb

from linkloom.operators import pages as O
from linkloom.plans import catalog


def test_a_cut_token_that_reads_as_another_wallet(spark, tmp_path):
    """A heading cut inside a hexadecimal token may look like a Bitcoin address; h10_wallets_phones asks for Ethereum, as its SQL does."""
    cut = "token = &quot;1" + "a3" * 14
    duckdb.execute(f"copy (select i as page_id, 'https://a' || i || '.example.com/' as url, '<h1>{cut}</h1><p>Call 01234 567 890' as html from range(8) t(i)) to '{tmp_path}/pages.parquet' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.execute(f"select page_id, wallets, phones from ({catalog.ORACLES['h10_wallets_phones']}) order by 1").fetchall()
    got = catalog.QUERIES["h10_wallets_phones"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.page_id, r.wallets, r.phones) for r in got] == want and {x[1] for x in want} == {"", "Ethereum"}
    texts = spark.createDataFrame([("1" + "a3" * 14 + " 0x" + "0" * 40,)], "x string")
    assert texts.select(O.wallets(texts.x), O.wallets(texts.x, ("Ethereum",))).first()[:] == (["Bitcoin", "Ethereum"], ["Ethereum"])
