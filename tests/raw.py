"""Literal raw requests for tests."""

import json

from footlog.plans.enrich import RAW_SCHEMA

CHROME = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"
IPHONE = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) "
    "Version/17.0 Mobile/15E148 Safari/604.1"
)
GPTBOT = "Mozilla/5.0 (compatible; GPTBot/1.2; +https://openai.com/gptbot)"
NOW = 1_767_268_800_000


def raw_frame(spark, requests):
    """Each request: (body, options); a dict body is written as JSON."""
    rows = []
    for i, (body, options) in enumerate(requests):
        o = {"received_at": NOW + i, "ip": "1.2.3.4", "user_agent": CHROME, "headers": {}, "host": ""} | options
        text = body if isinstance(body, str) else json.dumps(body)
        rows.append(
            (f"r{i}", i, text, o["received_at"], o["ip"], o["user_agent"], o["headers"], o["host"], o.get("signature"), o.get("signer"))
        )
    return spark.createDataFrame(rows, RAW_SCHEMA)


def sites_frame(spark, *rows):
    rows = rows or (("demo", "example.com", "standard"), ("quiet", "quiet.example", "strict"))
    return spark.createDataFrame(rows, "site_id string, domain string, privacy_mode string")
