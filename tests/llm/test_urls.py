"""The path-template tree against a plain-Python one."""

import math
import random
import re
from collections import defaultdict

from curastra.llm.url_filter import filter_urls, parse_rules

RULES = parse_rules("block", ["shop.com/item/8", "com/ads/"]) + parse_rules("allow", ["shop.com/item/7", "net/news/"])


def _rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def _shape(s):
    ext = re.search(r"\.[A-Za-z]{1,5}$", s)
    ext = ext[0] if ext else ""
    return ("<n>" if re.fullmatch("[0-9]+", s[: len(s) - len(ext)]) else "<*>") + ext


def _apart(x, top, alike):
    def differs(count, of):
        if x[of] == 0 or top[of] == 0:
            return False
        pooled = (x[count] + top[count]) / (x[of] + top[of])
        gap = abs(x[count] / x[of] - top[count] / top[of])
        return gap > alike and gap > 2 * math.sqrt(pooled * (1 - pooled) * (1 / x[of] + 1 / top[of]))

    return any(differs(c, "n") for c in ("ends", "numbers", "labelled")) or differs("blocked", "labelled")


def _template(pages, depth, support, alike):
    """Templates of the pages of one node, a list of (segments, rule), from ``depth`` on."""
    out, groups = {}, defaultdict(list)
    for i, (seg, rule) in pages.items():
        if len(seg) <= depth:
            out[i] = ""
        else:
            groups[seg[depth]].append(i)
    kept = []
    for s, ids in groups.items():
        after = [pages[i][0][depth + 1] if len(pages[i][0]) > depth + 1 else None for i in ids]
        labels = [pages[i][1] for i in ids if pages[i][1]]
        if len(ids) >= support:
            numbers = sum(a is not None and bool(re.fullmatch(r"[0-9]+(\.[A-Za-z]{1,5})?", a)) for a in after)
            kept.append({"s": s, "n": len(ids), "labelled": len(labels), "blocked": sum(r.verdict == "block" for r in labels), "ends": after.count(None), "numbers": numbers})
    name = {}
    while kept:
        top = max(kept, key=lambda b: (b["n"], b["s"]))
        name |= {b["s"]: f"({top['s']})" for b in kept if not _apart(b, top, alike)}
        kept = [b for b in kept if _apart(b, top, alike)]
    nodes = defaultdict(dict)
    for s, ids in groups.items():
        for i in ids:
            nodes[name.get(s) or _shape(s)][i] = pages[i]
    for part, below in nodes.items():
        out |= {i: f"/{part}{rest}" for i, rest in _template(below, depth + 1, support, alike).items()}
    return out


def _urls():
    rng = random.Random(7)
    urls = [f"http://shop.com/item/{n}" for n in list(range(80, 90)) + list(range(800, 880)) + [1, 2, 11, 345, 70]]
    urls += [f"http://a.shop.com/ads/{n}/x" for n in range(9)]
    for section in "abcdefgh":  # two alike kinds, neither of them the largest branch
        for n in range(rng.randint(12, 20)):
            urls.append(f"http://big.org/{section}/" + (str(rng.randint(1, 10**6)) if section < "e" else ""))
    urls += [f"http://big.org/long/word{n}/{'page' if n % 2 else n}.html" for n in range(60)]
    urls += [f"http://x.net/news/{rng.choice('abc')}/{n}" for n in range(40)] + [f"http://x.net/misc{n}" for n in range(4)]
    urls += ["http://shop.com", "http://shop.com//", None, "nothing"] * 3
    rng.shuffle(urls)
    return urls


def test_templates_against_plain_python(spark):
    urls = _urls()
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    hosts, rule = defaultdict(dict), {}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rule[i] = _rule(host, path)
        hosts[host][i] = ([s for s in path.split("/") if s], rule[i])
    assert len(got) == len(urls)
    blocked = 0
    for host, pages in hosts.items():
        template = _template(pages, 0, 5, 0.1)
        for i, t in template.items():
            labelled = [rule[j] for j in pages if template[j] == t and rule[j]]
            reject = (sum(r.verdict == "block" for r in labelled) + 2) / (len(labelled) + 4) >= 0.8
            want = rule[i].verdict if rule[i] else "block" if reject else "allow"
            assert (got[i].host, got[i].template, got[i].verdict) == (host, t, want)
            blocked += rule[i] is None and reject
    assert blocked == 4  # /item/<n> without a rule of their own
    names = {r.template for r in got.values() if r.host == "big.org"}
    assert sum(t.endswith("/<n>") for t in names) == 1 and sum(t.count("/") == 1 for t in names) == 1


def test_odd_rows(spark):
    rows = [(None, None), (None, "http://a.com/x/1"), (1, ""), (1, ""), (2, "http://a.com/" + "y/" * 200), (3, "HTTP://A.COM/Ads/1?q"), (4, "http://a.com/ads/" + "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'c' as host", "'c' as template", "1 as n")
    got = filter_urls(df, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template"] and got.count() == len(rows)
    assert {r.verdict for r in got.where("page_id = 4").collect()} == {"block"} and got.where("verdict is null").isEmpty()
    assert filter_urls(df.limit(0), RULES).isEmpty()
