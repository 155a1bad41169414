"""Boxes, page statistics, features, measures, tournaments and classification metrics."""

from __future__ import annotations

from .sqlop import operator

operator("bounding_boxes", "AGG1 AGG2 AGG3 AGG4 AGG5 AGG6 AGG7 AGG8 FN10 FN11 FN35 FN47", "fx_line", """
select page_id, region_no, min(x) as min_x, max(x + w) as max_x, min(y) as min_y, max(y + h) as max_y, max(x + w) - min(x) + 1 as width, max(y + h) - min(y) + 1 as height from fx_line group by page_id, region_no
""", "Bounding boxes; width and height count both ends.")
operator("node_geometric", "AGG9 AGG13", "fx_region fx_page", """
select r.page_id, r.region_no, round((r.x1 - r.x0) * 1.0 / p.width, 6) as w, round((r.y1 - r.y0) * 1.0 / p.height, 6) as h, round((r.x0 + r.x1) / 2.0 / p.width, 6) as cx, round((r.y0 + r.y1) / 2.0 / p.height, 6) as cy,
  case when r.region_type = 'heading' then 1.0 else 0.0 end as heading from fx_region r join fx_page p on p.page_id = r.page_id
""", "Size and centre of a region relative to the page, and the heading flag.")
operator("node_baseline", "AGG10", "fx_line fx_page", """
select l.page_id, l.region_no, round(max(case when f = 1 then l.w end) * 1.0 / max(p.width), 6) as first_w, round(max(case when f = 1 then l.x + l.w / 2.0 end) / max(p.width), 6) as first_cx, round(max(case when f = 1 then l.y + l.h end) * 1.0 / max(p.height), 6) as first_cy,
  round(max(case when b = 1 then l.w end) * 1.0 / max(p.width), 6) as last_w, round(max(case when b = 1 then l.x + l.w / 2.0 end) / max(p.width), 6) as last_cx, round(max(case when b = 1 then l.y + l.h end) * 1.0 / max(p.height), 6) as last_cy
from (select *, row_number() over (partition by page_id, region_no order by line_no) as f, row_number() over (partition by page_id, region_no order by line_no desc) as b from fx_line) l join fx_page p on p.page_id = l.page_id group by l.page_id, l.region_no
""", "Geometry of a region's first and last baseline.")
operator("node_height_norm", "AGG11 AGG12", "fx_line", """
select page_id, region_no, round(coalesce(max(case when txt <> 'AF' then h end), 0) * 1.0 / max(page_h), 6) as height from (select *, max(h) over (partition by page_id) as page_h from fx_line) t group by page_id, region_no
""", "Largest height of a region's lines with text relative to the page's.")
HEADING = """v as (select page_id, region_no, line_no, (line_no * 7 + page_id) % 5 as stroke, h as height, ((x + y) % 100) / 100.0 as net from fx_line),
s as (select *, case when max(stroke) over (partition by page_id) = min(stroke) over (partition by page_id) then 0.0 else (stroke - min(stroke) over (partition by page_id)) * 1.0 / (max(stroke) over (partition by page_id) - min(stroke) over (partition by page_id)) end as sw,
  case when max(height) over (partition by page_id) = min(height) over (partition by page_id) then 0.0 else (height - min(height) over (partition by page_id)) * 1.0 / (max(height) over (partition by page_id) - min(height) over (partition by page_id)) end as th from v),
c as (select *, case when sw >= 0.9 or th >= 0.9 or (sw + th) / 2 >= 0.8 or net >= 0.9 then 1.0 else 0.33 * net + 0.33 * sw + 0.33 * th end as confidence from s)"""
operator("heading_confidence", "AGG15 AGG17 FN27", "fx_line", f"""
with {HEADING} select page_id, region_no, line_no, round(sw, 6) as stroke_width, round(th, 6) as text_height, round(confidence, 6) as confidence, case when confidence > 0.5 then 1 else 0 end as is_heading from c
""", "A line's heading confidence: 1 if its stroke width or height (both scaled to the unit interval of the page), their mean or the network's value reaches its threshold, else a third of each.")
operator("heading_regions", "AGG15 AGG57", "fx_line", f"""
with {HEADING} select t.page_id, t.region_no, g.threshold, case when avg(case when t.confidence > g.threshold then 1.0 else 0.0 end) >= 1.0 then 1 else 0 end as is_heading
from c t cross join (select 0.4 as threshold union all select 0.5 as threshold union all select 0.6 as threshold) g group by t.page_id, t.region_no, g.threshold
""", "Regions all of whose lines are headings, for a grid of thresholds.")
operator("true_false_counts", "AGG24 AGG25 AGG26", "fx_score", """
select source, cast(sum(case when p >= 0.5 then 1 else 0 end) as bigint) as n_true, cast(sum(case when p < 0.5 then 1 else 0 end) as bigint) as n_false from fx_score group by source
""", "Entities whose score reaches the threshold, by group.")
operator("measure_summary", "AGG30 AGG31 AGG32", "fx_line", """
with c as (select page_id, sum(case when gt_id = hyp_id then 1.0 else 0 end) / nullif(sum(case when gt_id <> 2 then 1 else 0 end), 0) as r0, sum(case when gt_id = hyp_id then 1.0 else 0 end) / nullif(sum(case when hyp_id <> 2 then 1 else 0 end), 0) as p0 from fx_line group by page_id),
f as (select page_id, least(r0, 1.0) as r, least(p0, 1.0) as p from c)
select cast(count(*) as bigint) as n_all, cast(count(r) as bigint) as n_valid, round(avg(r), 6) as recall, round(avg(p), 6) as precision_, round(avg(case when r + p = 0 then 0.0 else 2 * r * p / (r + p) end), 6) as f from f
""", "Averages over the valid pages, and how many are valid; F is 0 if both parts are.")
operator("article_weights", "JOIN1", "fx_line", """
with c as (select page_id, gt_id, hyp_id, count(*) as n from fx_line group by page_id, gt_id, hyp_id), g as (select page_id, gt_id, count(*) as n from fx_line group by page_id, gt_id), h as (select page_id, hyp_id, count(*) as n from fx_line group by page_id, hyp_id)
select g.page_id, g.gt_id, h.hyp_id, round(coalesce(c.n, 0) * 1.0 / g.n, 6) as recall, round(coalesce(c.n, 0) * 1.0 / h.n, 6) as precision_, round(g.n * 1.0 / sum(g.n) over (partition by g.page_id, h.hyp_id), 6) as gt_weight
from g join h on g.page_id = h.page_id left join c on c.page_id = g.page_id and c.gt_id = g.gt_id and c.hyp_id = h.hyp_id
""", "Recall and precision of every ground truth article with every hypothesis of the page, and the weight of the former.")
operator("comparison_csv", "SINK8 IO16 FILT44 SINK9", "fx_line fx_page", """
select p.method, l.page_id, cast(count(*) as bigint) as n, case when lower(p.method) in ('m0', 'm2') then cast(count(distinct l.hyp_id) as bigint) end as hyp_nis from fx_line l join fx_page p on p.page_id = l.page_id group by p.method, l.page_id
""", "Comparison rows; results of methods that aren't asked for are null.")
operator("accuracy", "AGG42 AGG46 FN4 FN3", "fx_score", """
select lang, round(avg(cast(case when (p >= 0.5) = (y = 1) then 1 else 0 end as double)), 6) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision_, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1
from (select *, cast(sum(case when p >= 0.5 and y = 1 then 1 else 0 end) over (partition by lang) as double) as tp, cast(sum(case when p >= 0.5 and y = 0 then 1 else 0 end) over (partition by lang) as double) as fp, cast(sum(case when p < 0.5 and y = 1 then 1 else 0 end) over (partition by lang) as double) as fn from fx_score) t group by lang, tp, fp, fn
""", "Accuracy, precision, recall and F1; 0 where nothing is to divide by.")
operator("macro_micro_f1", "AGG42 AGG57", "fx_score", """
with s as (select sum(case when p >= 0.5 and y = 1 then 1 else 0 end) as tp, sum(case when p >= 0.5 and y = 0 then 1 else 0 end) as fp, sum(case when p < 0.5 and y = 1 then 1 else 0 end) as fn, sum(case when p < 0.5 and y = 0 then 1 else 0 end) as tn from fx_score),
c as (select 0 as cls, tn as tp, fn as fp, fp as fn from s union all select 1 as cls, tp, fp, fn from s),
f as (select cls, tp, fp, fn, tp + fn as support, case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from c)
select round(avg(f1), 6) as macro, round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) as micro, round(sum(f1 * support) / sum(support), 6) as weighted, round(max(case when cls = 1 then f1 end), 6) as binary_ from f
""", "F1 averaged over classes, over decisions, and by support.", other="""
with k as (select 0 as cls union all select 1 as cls), c as (select cls, sum(case when y = cls and (p >= 0.5) = (cls = 1) then 1 else 0 end) as tp, sum(case when y <> cls and (p >= 0.5) = (cls = 1) then 1 else 0 end) as fp, sum(case when y = cls and (p >= 0.5) <> (cls = 1) then 1 else 0 end) as fn from fx_score cross join k group by cls),
f as (select cls, tp, fp, fn, tp + fn as support, case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from c)
select round(avg(f1), 6) as macro, round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) as micro, round(sum(f1 * support) / sum(support), 6) as weighted, round(max(case when cls = 1 then f1 end), 6) as binary_ from f
""")
operator("cross_entropy", "AGG43 AGG55 AGG56", "fx_score", """
select round(-avg(y * ln(greatest(p, 0.001)) + (1 - y) * ln(greatest(1 - p, 0.001))), 6) as loss, round(sum(p * p) / 2.0, 6) as l2, cast(sum(case when p > 0 then 1 else 0 end) as bigint) as n from fx_score
""", "Mean cross-entropy with clamped scores, and half the sum of squares.")
operator("pixel_histogram", "AGG47 AGG48 AGG19 FN30", "fx_line", """
select value, cast(count(*) as bigint) as n, round(count(*) * 1.0 / sum(count(*)) over (), 9) as share from (select (x + y * 3 + w) % 256 as value from fx_line) t group by value
""", "Histogram of 256 grey values and their shares.")
operator("profiles", "AGG49 FILT30", "fx_line", """
select page_id, y as row_, round(sum(w) / 2000.0, 6) as share from fx_line group by page_id, y having sum(w) / 2000.0 > 0.15
""", "Rows of a page whose share of ink exceeds the threshold.")
operator("moments", "AGG53 AGG54", "fx_line", """
select page_id, line_no, round((w - avg(w) over (partition by page_id)) / greatest(stddev_pop(w) over (partition by page_id), 0.0001), 6) as standardised, round(var_pop(w) over (partition by page_id), 4) as variance from fx_line
""", "Standardised values of a page.")
operator("relative_likelihood", "AGG40 FN34", "fx_conf fx_line", """
select c.page_id, round(sum(ln(c.p / (1 - c.p))), 4) as llh, cast(count(*) as bigint) as n from fx_conf c join fx_line a on a.page_id = c.page_id and a.line_no = c.i join fx_line b on b.page_id = c.page_id and b.line_no = c.j where a.gt_id = b.gt_id group by c.page_id
""", "Sum of the log-odds of pairs of one label.")
operator("message_sum", "AGG50", "fx_edge", """
select page_id, dst, round(sum(u0), 6) as s0, round(sum(u1), 6) as s1, round(max(u0), 6) as m0, round(sum(u0 * u0), 6) as q0 from fx_edge group by page_id, dst
""", "Messages of the incoming edges, summed and their maximum.")
operator("balanced_attention", "AGG51", "fx_edge", """
select page_id, src, dst, round(1.0 / count(*) over (partition by page_id, dst), 6) as weight from fx_edge
""", "Each incoming edge weighs one over the in-degree.")
operator("softmax_attention", "AGG52 FN52", "fx_edge", """
with m as (select page_id, src, dst, exp(score - max(score) over (partition by page_id, dst)) as e from fx_edge) select page_id, src, dst, round(e / sum(e) over (partition by page_id, dst), 6) as weight from m
""", "Softmax of the incoming edges' scores.")
operator("swt_features", "AGG16", "fx_line", """
select page_id, region_no, round(avg(h), 6) as mean_h, round(median(w), 6) as median_w, max(h) - min(h) as spread from fx_line group by page_id, region_no
""", "Summary statistics of a region's lines.")
operator("early_stopping", "WIN2 IO33", "events", """
with s as (select event_type, @day as step, avg(value) as metric from events where value is not null group by event_type, @day),
p as (select *, max(metric) over (partition by event_type order by step rows between unbounded preceding and 1 preceding) as before_ from s),
g as (select *, max(case when before_ is null or metric > before_ then step end) over (partition by event_type order by step rows between unbounded preceding and current row) as best_step from p)
select event_type, cast(step as bigint) as step, round(metric, 6) as metric, cast(best_step as bigint) as best_step, cast(max(case when step - best_step >= 3 then 1 else 0 end) over (partition by event_type order by step rows between unbounded preceding and current row) as int) as stopped from g
""", "Stops once the last step that beat all before it is three steps or more ago; a tie is no gain.", (("@day", "datediff(cast(ts as date), date'1970-01-01')"),), (("@day", "date_diff('day', date '1970-01-01', cast(ts as date))"),))
operator("block_scores", "AGG41", "documents embeddings", """
with t as (select doc_id, @words as t from documents), k as (select doc_id, t from t where @alpha and t not in ('the', 'and', 'of', 'to', 'in')),
v as (select vec_id, cast(floor(256 * cast(@first as double)) as bigint) as v0, cast(floor(256 * cast(@second as double)) as bigint) as v1 from embeddings where vec_id < 97)
select doc_id, cast(count(*) as bigint) as n_tokens, cast(sum(v0) as bigint) as s0, cast(sum(v1) as bigint) as s1 from k join v on v.vec_id = (length(t) * 31 + ascii(t)) % 97 group by doc_id having count(*) >= 5
""", "Sum of the vectors of a block's words, without stop words and what isn't letters; blocks of fewer than five are ignored.",
         (("@words", "explode(split(translate(lower(text), chr(10), ' '), ' '))"), ("@alpha", "t rlike '^[a-z]+$'"), ("@first", "embedding[0]"), ("@second", "embedding[1]")),
         (("@words", "unnest(string_split(translate(lower(text), chr(10), ' '), ' '))"), ("@alpha", "regexp_full_match(t, '[a-z]+')"), ("@first", "embedding[1]"), ("@second", "embedding[2]")))
