import json
import random

import pytest

from tesseral.functions import capacity
from tesseral.operators.capacity import check_certificates, evaluate_requests

#: Published bounds and digests.
GOLDEN = [
    (64, 8, 421688057462785),
    (64, 16, 26184380591),
    (64, 24, 19883522),
    (128, 16, 3395184828163349608402497490),
    (128, 32, 22396032652922403638),
    (128, 48, 19391329499178),
    (256, 32, 162372326214067081141448504628655429554456941526568067),
    (256, 64, 12071934357881141822097984615890981597),
    (256, 96, 13683528021137272041170604),
]
#: The published sample request.
EXAMPLE = {
    "schema_version": 1,
    "request_id": "binary-128-d48-48bit",
    "representation": {"kind": "binary", "dimension": 128, "required_states": "281474976710656", "separation": {"minimum_hamming_distance": 48}},
    "construction": {"enabled": False},
    "bounds": {"engines": ["finite-binary-hamming"], "require_rigorous_certificate": True},
    "resources": {"maximum_dimension": 1024, "maximum_certificate_bytes": 16777216},
}


def binary(n, d, states, **more):
    return json.dumps(EXAMPLE | {"representation": {"kind": "binary", "dimension": n, "required_states": str(states), "separation": {"minimum_hamming_distance": d}}} | more)


def spherical(n, s, states):
    asked = {"kind": "spherical", "ambient_dimension": n, "required_states": str(states), "normalization": "unit_l2", "separation": {"maximum_inner_product": s}}
    return json.dumps(EXAMPLE | {"representation": asked, "bounds": {"engines": ["finite-spherical-rankin"]}})


@pytest.mark.parametrize(("n", "d", "want"), GOLDEN)
def test_hamming_bounds(n, d, want):
    assert capacity.hamming_bound(n, d) == want


def test_golden_digest():
    got = capacity.evaluate(json.dumps(EXAMPLE))
    assert got["digest"] == "bf07d33d87446d29c461e6bcbbad64a9bbb94675268c7f142cf00f7fc04546f9"
    assert got["outcome"] == "INFEASIBLE_UNDER_MODEL" and got["exit_code"] == 1
    assert capacity.check_json(got["certificate"]) == ("VALID", "")


@pytest.mark.parametrize(
    ("request_", "outcome", "upper"),
    [
        (binary(8, 3, 29), "INFEASIBLE_UNDER_MODEL", "28"),
        (binary(8, 3, 28), "UNKNOWN", "28"),
        (spherical(64, "0", 129), "INFEASIBLE_UNDER_MODEL", "128"),
        (spherical(64, "-0.25", 6), "INFEASIBLE_UNDER_MODEL", "5"),
        (spherical(64, "-00.250", 6), "INFEASIBLE_UNDER_MODEL", "5"),
        (spherical(64, "0.25", 10**9), "UNKNOWN", None),
        (spherical(64, "-1", 3), "INFEASIBLE_UNDER_MODEL", "2"),
        (binary(8, 3, 28, construction={"enabled": True}), "REFUSED", "28"),
        (binary(8, 3, 29, bounds={"engines": []}), "UNKNOWN", None),
        (binary(8, 3, 29, bounds={"engines": ["other"]}), "UNKNOWN", None),
        (binary(8, 3, 29, bounds={"engines": ["finite-binary-hamming", "other"]}), "REFUSED", None),
        (binary(8, 9, 2), "REFUSED", None),
        (binary(0, 1, 2), "REFUSED", None),
        (binary(2000, 1, 2), "REFUSED", None),
        (binary(8, 3, "029"), "REFUSED", None),
        (binary(8, 3, 0), "REFUSED", None),
        (binary(8, 3, 29).replace('"29"', "29"), "REFUSED", None),
        (binary(8, 3, 29, extra=1), "REFUSED", None),
        (binary(8, 3, 29).replace('"schema_version": 1', '"schema_version": 1, "schema_version": 1'), "REFUSED", None),
        (binary(8, 3, 29).replace('"schema_version": 1', '"schema_version": 2'), "REFUSED", None),
        (spherical(64, "1", 3), "REFUSED", None),
        (spherical(64, "1e-1", 3), "REFUSED", None),
        (spherical(1, "0", 3), "REFUSED", None),
        (binary(8, 3, 29, request_id="bad id"), "REFUSED", None),
        (binary(8, 3, 29, resources={"maximum_certificate_bytes": 10}), "REFUSED", "28"),
        ("", "REFUSED", None),
        ("[]", "REFUSED", None),
        ("x" * (1 << 21), "REFUSED", None),
    ],
)
def test_outcomes(request_, outcome, upper):
    got = capacity.evaluate(request_)
    assert (got["outcome"], got["upper_bound"]) == (outcome, upper), got["reason"]


def test_any_change_of_a_certificate_is_met():
    proof = json.loads(capacity.evaluate(binary(8, 3, 29))["certificate"])
    assert capacity.check(proof)[0] == "VALID"
    for change in (
        {"claimed_upper_bound": "27"},
        {"required_states": "30"},
        {"request_digest": "0" * 64},
        {"witness": proof["witness"] | {"correction_radius": 2}},
        {"arithmetic": proof["arithmetic"] | {"floating_point_used": True}},
        {"theorem": "spherical-rankin-orthoplex-v1"},
        {"normalized_request": proof["normalized_request"] | {"request_id": "x"}},
        {"extra": 1},
    ):
        assert capacity.check(proof | change)[0] == "INVALID", change
    for change in ({"schema_version": 2}, {"theorem": "later-bound-v9"}, {"checker_requirements": proof["checker_requirements"] | {"minimum_checker_schema_version": 2}}):
        assert capacity.check(proof | change)[0] == "UNSUPPORTED", change
    text = json.dumps(proof)
    rng = random.Random(1)
    for _ in range(200):
        assert capacity.check_json(text[: rng.randrange(len(text))])[0] == "INVALID"


def test_tables(spark):
    requests = [(1, binary(8, 3, 29)), (2, binary(8, 3, 28)), (3, None)]
    found = evaluate_requests(spark.createDataFrame(requests, "request_no int, request string"))
    assert {r.request_no: (r.outcome, r.exit_code) for r in found.collect()} == {1: ("INFEASIBLE_UNDER_MODEL", 1), 2: ("UNKNOWN", 2), 3: ("REFUSED", 3)}
    assert {r.request_no: r.verdict for r in check_certificates(found).collect()} == {1: "VALID", 2: "INVALID", 3: "INVALID"}
