"""Write the physical plan trees of the headline queries to docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]
Uses ``explain("formatted")`` and keeps the operator tree (the numbered
detail section is dropped to keep the file readable).
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from feedpulse.plans.catalog import REGISTRY  # noqa: E402
from feedpulse.session import local_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    return text.split("\n\n(1)")[0].strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{os.path.basename(sf)}` (before AQE re-planning).", ""]
    for name in HEADLINE:
        out += [f"## {name}", "", "```", tree(REGISTRY[name].build(spark, sf)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
