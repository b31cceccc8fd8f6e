"""The flagship question as a registered query."""

from __future__ import annotations

from busline.plans.flagship import flagship
from busline.plans.registry import query
from busline.plans.views import Tables


@query("whitelist_by_split", """
WITH k AS (SELECT split, source_file, w, max(binary_label_id) AS y, max((can_id NOT IN (SELECT can_id FROM sg WHERE split = 'train' AND binary_label_id = 0))::INT) AS pred FROM (
SELECT *, unnest(generate_series(greatest(0, CAST(ceil((gi - 127) / 32.0) AS BIGINT)), least(gi // 32, (gn - 128) // 32))) AS w FROM sg WHERE gn >= 128) GROUP BY ALL),
c AS (SELECT split, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM k GROUP BY split)
SELECT split, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
 round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT), 6) AS macro_f1,
 round(tp / nullif(tp + fn, 0), 6) AS attack_recall, round(tn / nullif(tn + fp, 0), 6) AS normal_recall, round(fp / nullif(tn + fp, 0), 6) AS fpr FROM c""")
def whitelist_by_split(t: Tables):
    return flagship(t.spark, t.dir)
