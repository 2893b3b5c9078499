"""Long texts made of a pattern's own beginnings: no error, no time that grows with their square."""

import time

import pyarrow as pa
import pytest

from lexmill.llm import licenses, secrets

MB = 1 << 20


@pytest.mark.parametrize("piece", ["eyJ", "eyJaaaaaaaa.", "token", "token ", "secret:", "AKIA", "0123456789abcdef ", "ghp_", "xoxb-", "AIza", "sk_live_", "npm_", "://a:", "://", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----"])
def test_secret_rules_are_linear(piece):
    began = time.time()
    secrets.Scanner().scan(pa.array([piece * (MB // len(piece)) + " .ey"]))
    assert time.time() - began < 20


def test_tokens_are_found_where_they_begin():
    scan = lambda t: [s[1] for s in secrets.Scanner().scan(pa.array([t]))[0]]
    jwt = [i for i, r in enumerate(secrets.RULES) if r.kind == "jwt"]
    token = ".".join(["eyJhbGciOiJI", "eyJzdWIiOiIx", "SflKxwRJSMeK"])
    assert scan(f"x {token} y") == jwt and scan(f"={token}") == jwt and scan(f"a{token}") == []


def test_license_steps_bear_long_runs(spark):
    runs = ["\n", " ", "\n*", ".", ". ", "v.", "2.0 (", "a) ", "S", "\r\n", "# \n"]
    texts = ["Released under the MIT License.\n" + r * (MB // len(r)) + "end" for r in runs]
    texts.append("Licensed under the MIT License\n\n *\n * https://x")
    began = time.time()
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert [r["licences"] for r in got] == ["MIT"] * len(texts)


def test_three_clauses_are_not_two(spark):
    clauses = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
               "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
               "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    rows = [(1, "\n".join(clauses)), (2, "\n".join(clauses[:3]))]
    got = {r["doc_id"]: r["licences"] for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-2-Clause"}
