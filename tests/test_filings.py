"""The structure of hand-made filings."""

import math

import pytest

from tidemark.functions import filings


def test_structure_of_filings(spark):
    long = "word " * 4000
    bodies = [
        None,
        "",
        "Cover. Item 8.01 Other. " + long + "The FDA\nhas approved it. item 9.01 Exhibits\n\n EX-99.1 \nphase 2 phase II\nSIGNATURES\nphase 3",
        "\nEXHIBIT 99\nItem 5.02 appointed a new director",
        "Sold for $2 billion and $900 million; purchase price of $ 6.00. N = 0, n=25. P = 0.04 p < .003 Hazard ratio was 0.5. Safe Harbor: warrants",
        "Item 2.02 a Item 2.02 b Item 1.01 c " + "warrant " * 30,
    ]
    rows = [(i, "H", b, math.log(4.0) if i != 3 else None, "clash") for i, b in enumerate(bodies)]
    got = {r["k"]: r for r in filings.structure(spark.createDataFrame(rows, "k int, headline string, body string, p double, taxonomy_text string"), "headline", "body", "p").collect()}
    for empty in (got[0], got[1]):
        assert (empty["items"], empty["item_pairs"], empty["taxonomy"], empty["body_present"], empty["max_amount_log"], empty["offer_vs_entry"]) == ("", "", "", False, 0.0, None)
    two = got[2]
    assert (two["items"], two["item_pairs"], two["exhibit_present"], two["signature_present"]) == ("8.01,9.01", "8.01|9.01", True, True)
    assert two["taxonomy"] == "fda_approval:1:1:0,phase_2:2:0:1"  # what follows the signature is not read
    assert two["log_primary_len"] > 9.9  # a long text is read whole
    three = got[3]
    assert (three["items"], three["exhibit_present"], three["taxonomy"]) == ("5.02", True, "management_appointment:1:0:1")  # the exhibit stands before the first item
    four = got[4]
    assert four["taxonomy"] == "" and four["disclaimer_present"]
    assert four["max_amount_log"] == pytest.approx(math.log1p(2e9), abs=1e-6) and four["offer_vs_entry"] == pytest.approx(0.5)
    assert four["max_subjects_log"] == pytest.approx(math.log1p(25), abs=1e-6)
    assert four["least_p_neglog"] == pytest.approx(-math.log10(0.003), abs=1e-6) and four["hazard_ratio_log"] == pytest.approx(math.log(0.5), abs=1e-6)
    five = got[5]
    assert (five["items"], five["item_pairs"], five["taxonomy"]) == ("1.01,2.02", "1.01|2.02", "warrant:10:1:0")  # at most ten are counted
