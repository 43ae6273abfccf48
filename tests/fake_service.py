"""A service for the tests of the API source: 250 pages of two sources, refusing every seventh request once."""

import json
import re

PAGES = [{"object": "page", "id": f"p{n}", "last_edited_time": f"2025-01-01T{n // 60:02d}:{n % 60:02d}:00Z", "parent": {"data_source_id": f"s{n % 2}"}, "properties": {}} for n in range(250)]
SEEN: list[str] = []


def call(method, address, body, headers):
    SEEN.append(address)
    if len(SEEN) % 7 == 0:
        return (429, {"Retry-After": "0"}, "slow down") if len(SEEN) % 2 else (503, {"retry-after": "0"}, "busy")
    if not headers.get("Authorization"):
        return 401, {}, "no token"
    asked = json.loads(body) if body else dict(x.split("=") for x in address.partition("?")[2].split("&"))
    rows = PAGES
    if m := re.search("data_sources/(\\w+)/query", address):
        since = asked.get("filter", {}).get("last_edited_time", {}).get("on_or_after", "")
        rows = [p for p in PAGES if p["parent"]["data_source_id"] == m[1] and p["last_edited_time"] >= since]
        rows = rows if asked["sorts"][0]["direction"] == "ascending" else rows[::-1]
    elif address.endswith("/search"):
        rows = PAGES[::-1] if asked["sort"]["direction"] == "descending" else PAGES
    elif "/users" in address or "/children" in address:
        rows = PAGES[:120]
    at = int(asked.get("start_cursor", 0))
    end = at + int(asked["page_size"])
    return 200, {}, json.dumps({"results": rows[at:end], "has_more": end < len(rows), "next_cursor": str(end) if end < len(rows) else None})
