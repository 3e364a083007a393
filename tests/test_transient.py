"""Reports that fall short only by fetches which may succeed later."""

from __future__ import annotations

import pytest

from newsweft.operators.gates import transient_blocks

REPORT = "report_id string, reasons array<string>, discovered long, accepted long, retryable long, least_items long, least_bps long"
FEW, LOW = "accepted_items_below_minimum", "acceptance_ratio_below_minimum"


@pytest.mark.parametrize(
    "reasons,discovered,accepted,retryable,least_items,least_bps,want",
    [
        ([FEW], 10, 2, 1, 3, 3000, (3, True)), ([FEW, LOW], 10, 2, 1, 3, 3000, (3, True)), ([FEW], 10, 2, 1, 4, 3000, (3, False)), ([LOW], 10, 2, 1, 1, 3001, (3, False)), ([FEW, "repeated_content"], 10, 2, 5, 3, 3000, (7, False)),
        ([], 10, 2, 5, 3, 3000, (7, False)), ([FEW], 10, 2, 0, 1, 0, (2, False)), ([FEW], 4, 2, 50, 4, 10000, (4, True)), ([FEW], 0, 0, 1, 0, 0, (0, True)), (None, 10, 2, 5, 3, 3000, (7, False)),
    ],
)
def test_transient_blocks(spark, reasons, discovered, accepted, retryable, least_items, least_bps, want):
    row = transient_blocks(spark.createDataFrame([("r", reasons, discovered, accepted, retryable, least_items, least_bps)], REPORT)).first()
    assert (row["possible"], row["blocked"]) == want
