"""Layout tables derived from the base tables; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Text lines, pages, regions, separators; then blocks, vectors, scores and events.
SQL = {
    "fx_line": """select page_id, line_no, region_no, gt_id, hyp_id, x, line_no * 40 + sk % 7 as y, w, h, txt from (
  select l_orderkey as page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as line_no,
    l_linenumber as region_no, l_suppkey as sk, l_suppkey % 3 as gt_id, l_partkey % 3 as hyp_id, (l_partkey % 40) * 25 as x, cast(floor(100 + l_quantity * 10) as bigint) as w, 20 + l_suppkey % 9 as h,
    concat(l_returnflag, l_linestatus) as txt from lineitem) a""",
    "fx_page": "select o_orderkey as page_id, cast(2000 as bigint) as width, 1000 + o_custkey % 500 as height, concat('m', cast(o_custkey % 4 as varchar(10))) as method from orders",
    "fx_region": "select page_id, region_no, min(x) as x0, max(x + w) as x1, min(y) as y0, max(y + h) as y1, count(*) as n_lines, case region_no % 4 when 0 then 'heading' when 1 then 'paragraph' when 2 then 'caption' end as region_type from fx_line group by page_id, region_no",
    "fx_sep": """select o_orderkey as page_id, (o_custkey % 20) * 50 as x0, (o_custkey % 20) * 50 + case when o_custkey % 2 = 0 then 800 else 4 end as x1, (o_orderkey % 6) * 40 as y0,
  (o_orderkey % 6) * 40 + case when o_custkey % 2 = 0 then 4 else 400 end as y1, case o_custkey % 3 when 0 then 'horizontal' when 1 then 'vertical' end as orientation from orders where o_orderkey % 3 <> 0""",
    "fx_base": """select page_id, 0 as side, line_no, nullif(gt_id, 2) as article, x as x0, y + h as y0, x + cast(floor(w / 2) as bigint) as x1, y + h + line_no % 3 * 2 as y1, x + w as x2, y + h as y2 from fx_line
  union all select page_id, 1 as side, line_no, nullif(hyp_id, 2) as article, x + (line_no * 5 + page_id) % 9 - 4 as x0, y + h + (line_no * 7 + page_id) % 15 - 4 as y0, x + cast(floor(w / 2) as bigint) as x1, y + h + (line_no * 7 + page_id) % 15 - 2 as y1,
    x + w + (line_no + page_id) % 6 as x2, y + h + (line_no * 7 + page_id) % 21 - 4 as y2 from fx_line where (page_id + line_no) % 11 <> 0""",
    "fx_conf": "select a.page_id, a.line_no as i, b.line_no as j, (1 + (a.line_no * 7 + b.line_no * 13 + a.page_id) % 98) / 100.0 as p from fx_line a join fx_line b on a.page_id = b.page_id and a.line_no <> b.line_no",
    "fx_method": "select page_id, line_no, gt_id, 'a' as method, hyp_id from fx_line union all select page_id, line_no, gt_id, 'b' as method, region_no % 3 as hyp_id from fx_line union all select page_id, line_no, gt_id, 'c' as method, case when line_no % 3 = 0 then 0 else gt_id end as hyp_id from fx_line",
    "fx_vec": "select cast(floor(vec_id / 20) as bigint) as page_id, vec_id % 20 as node, embedding as v, label from embeddings",
    "fx_score": "select l.doc_id, l.quality as y, (d.n_chars % 101) / 100.0 as p, d.source, d.lang from labels l join documents d on l.doc_id = d.doc_id",
    "fx_edge": "select a.page_id, a.region_no as src, b.region_no as dst, (a.x0 + b.x1) % 17 - 8.0 as score, a.x0 / 1000.0 as u0, a.y0 / 1000.0 as u1 from fx_region a join fx_region b on a.page_id = b.page_id and a.region_no <> b.region_no",
}
#: Inputs of a fixture that are dealt by a key before anything is derived from them: only what is read is shuffled, and Spark knows
#: that pages, being that key, stay together.
DEALT = {"fx_line": {"lineitem": "l_orderkey"}}


def _needs(text: str) -> list[str]:
    return [n for n in SQL if re.search(rf"\b{n}\b", text)]


def with_fixtures(text: str) -> str:
    """A DuckDB query with the fixtures that it uses as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _needs(SQL[name]):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in _needs(text):
        add(n)
    if not wanted:
        return text
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in wanted)
    m = re.match(r"\s*with\s+(recursive\s+)?", text)
    return f"with {m[1] or ''}{ctes}, {text[m.end() :]}" if m else f"with {ctes} {text}"


class Layout:
    """The tables of one folder: base tables and fixtures, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in SQL:
                names = _needs(SQL[name]) + [b for b in BASE if re.search(rf"(?:from|join) {b}\b", SQL[name])]
                text = SQL[name]
                for n in names:
                    text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text)
                self._made[name] = self.spark.sql(text, **{n: self.table(n) if n not in DEALT.get(name, {}) else self.table(n).repartition(DEALT[name][n]) for n in names})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]
