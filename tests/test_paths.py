"""Paths of XML elements from blocks, against a parser that reads whole files."""

import random
from collections import Counter
from xml.etree import ElementTree

from halyard.sources import documents


def tree(r, depth=0):
    name = r.choice(["a", "b", "n:c", "d-e"])
    if depth > 4 or r.random() < 0.3:
        return r.choice([f"<{name}/>", f'<{name} x="1"\n y="2" />', f"<{name}>t &lt; u</{name}>"])
    between = ["", "\n", "<!-- <a> -- > -->".replace("-- >", "- >"), "<![CDATA[<b>]] >]]>", "<!---->", "<?p q?>", " text "]
    return f"<{name}>" + "".join(r.choice(between) + tree(r, depth + 1) for _ in range(r.randrange(1, 5))) + r.choice(between) + f"</{name}>"


def test_paths_across_blocks(spark, tmp_path):
    r, want = random.Random(8), Counter()
    for k in range(4):
        text = '<?xml version="1.0"?>\n<r xmlns:n="u">' + "".join(tree(r) for _ in range(25)) + "</r>\n"
        (tmp_path / f"{k}.xml").write_text(text)

        def walk(e, at, k=k):
            path = f"{at}/{e.tag.rpartition('}')[2]}".lstrip("/")
            want[str(k), path] += 1
            for x in e:
                walk(x, path)

        walk(ElementTree.fromstring(text), "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = {(x.file[-5], x.path): x.n for x in documents.path_counts(spark, str(tmp_path)).collect()}
        tags = {x.element: x.n for x in documents.tag_counts(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(want)
    last = Counter()
    for (_, path), n in got.items():
        last[path.rpartition("/")[2]] += n
    assert dict(last) == tags
