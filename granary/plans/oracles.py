"""The same queries in SQL."""

OBS = """
obs AS (SELECT vec_id AS media_id, embedding::DOUBLE[] AS vector, label, vec_id AS i,
  CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 37 % 181 - 90)::DOUBLE END AS yaw, (20 + vec_id * 7 % 200)::DOUBLE AS width,
  (vec_id * 13 % 100) / 250 AS ratio, (vec_id * 17 % 90) / 10 AS blur, (vec_id * 29 % 101) / 100 AS exposure,
  least(1.0, (20 + vec_id * 7 % 200) / 160) AS resolution, (vec_id * 31 % 101) / 100 AS margin, (vec_id * 23 % 101) / 100 AS luma,
  CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS face_count, CASE WHEN vec_id % 3 = 0 THEN (vec_id * 19 % 101) / 100 END AS appearance,
  CASE WHEN vec_id % 5 = 0 THEN (vec_id * 41 % 101) / 100 END AS body_confidence
  FROM embeddings),
qual AS (SELECT *, 0.40 * greatest(0, least(1, blur / 8)) + 0.25 * exposure + 0.20 * resolution + 0.15 * margin AS q FROM obs),
parts AS (SELECT label, unnest(range(len(vector))) AS pos, unnest(vector) AS x, greatest(q, 0.01) AS w FROM qual WHERE media_id < 50),
sums AS (SELECT label, pos, sum(x * w) AS s FROM parts GROUP BY label, pos),
norms AS (SELECT label, sqrt(sum(s * s)) AS n FROM sums GROUP BY label),
cent AS (SELECT label, list(s / n ORDER BY pos) AS centroid FROM sums JOIN norms USING (label) GROUP BY label)"""


def cand(least: float, name: str, label: int = 0) -> str:
    return f"""
{name}0 AS (SELECT qual.*, round(list_cosine_similarity(vector, (SELECT centroid FROM cent WHERE label = {label})), 6) AS similarity, round(q, 6) AS quality_score,
  round({least} - 0.10 * least(1.0, abs(coalesce(yaw, 0)) / 45), 6) AS threshold,
  CASE WHEN ratio >= 0.22 THEN 'close' WHEN ratio >= 0.10 THEN 'medium' ELSE 'far' END AS scale_bin,
  CASE WHEN yaw IS NULL THEN 'unknown' WHEN yaw <= -40 THEN 'left_profile' WHEN yaw < -15 THEN 'left_three_quarter'
       WHEN yaw >= 40 THEN 'right_profile' WHEN yaw > 15 THEN 'right_three_quarter' ELSE 'frontal' END AS pose_bin,
  CASE WHEN luma < 0.30 THEN 'dark' WHEN luma > 0.72 THEN 'bright' ELSE 'normal' END AS light_bin FROM qual),
{name}1 AS (SELECT *, CASE WHEN similarity < threshold THEN 'below_similarity' WHEN width < 48 OR ratio < 0.04 THEN 'face_too_small'
  WHEN blur < 0.0375 THEN 'low_quality_blur' WHEN exposure < 0.075 THEN 'low_quality_exposure' WHEN quality_score < 0.15 THEN 'low_quality'
  WHEN abs(yaw) > 60 THEN 'pose_too_extreme' END AS reason,
  greatest(0, least(1, (similarity - {least}) / (1 - {least}))) AS n, greatest(0, least(1, ratio / 0.22)) AS f,
  CASE WHEN yaw IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(yaw) / 45) END AS p, greatest(0, least(1, (appearance - 0.65) / 0.30)) AS a FROM {name}0),
{name} AS (SELECT *, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'rejected' END AS status,
  width >= 48 AND ratio >= 0.04 AND quality_score >= 0.15 AND blur >= 0.0375 AND exposure >= 0.075 AND coalesce(abs(yaw) <= 60, TRUE)
    AND face_count = 1 AND similarity >= round(threshold - 0.15, 6) AS fallback_eligible,
  round(CASE WHEN appearance IS NULL THEN 0.50 * n + 0.25 * quality_score + 0.15 * f + 0.10 * p
    ELSE 0.30 * n + 0.40 * a + 0.12 * quality_score + 0.08 * f + 0.10 * p END, 6) AS base,
  face_count = 1 AND scale_bin = 'far' AND body_confidence IS NOT NULL AS body_focused FROM {name}1)"""


C = f"WITH {OBS},{cand(0.05, 'c')} "
DET = """WITH d AS (SELECT l_orderkey AS image, l_linenumber::BIGINT AS det, ((l_partkey * 31 + l_linenumber * 17) % 1000) / 1000 AS score,
  (l_partkey % 1000)::DOUBLE AS x1, ((l_partkey * 7 + l_suppkey * 13) % 800)::DOUBLE AS y1,
  (l_partkey % 1000 + 40 + l_partkey % 160)::DOUBLE AS x2, ((l_partkey * 7 + l_suppkey * 13) % 800 + 40 + l_suppkey * 11 % 160)::DOUBLE AS y2,
  l_partkey AS part, l_suppkey AS supp FROM lineitem),
t AS (SELECT image, det AS tdet, part AS tpart, supp AS tsupp, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM d
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, det, part, supp) = 1) """
FRAMES = "WITH f AS (SELECT user_id AS source, event_id AS id, epoch_us(ts) / 1e6 AS seconds, value AS score FROM events) "
IMAGES = "WITH i AS (SELECT p_partkey AS image, 400 + p_partkey * 37 % 1800 AS width, 400 + (p_partkey * 53 + p_size * 29) % 1800 AS height FROM part) "
SHAPES = "(SELECT w.x AS bw, h.x AS bh, row_number() OVER (ORDER BY w.x, h.x) AS k FROM (VALUES (512), (768), (1024)) w(x), (VALUES (512), (768), (1024)) h(x))"


def run(name: str, floor: int) -> str:
    return f"""
r{name} AS (SELECT media_id, row_number() OVER (ORDER BY similarity DESC, quality_score DESC, media_id) AS rank FROM {name}
  WHERE width >= {floor} AND (status = 'eligible' OR fallback_eligible) QUALIFY rank <= 20),
x{name} AS (SELECT media_id, CASE WHEN width < {floor} THEN 0 ELSE face_count END AS face_count, CASE WHEN width >= {floor} THEN similarity END AS similarity,
  CASE WHEN width < {floor} THEN 'rejected' ELSE status END AS status, CASE WHEN width < {floor} THEN 'no_face' ELSE coalesce(reason, '') END AS reason, rank,
  CASE WHEN rank IS NOT NULL THEN scale_bin END AS strategy, CASE WHEN rank IS NOT NULL THEN CASE WHEN base >= 0.5 THEN 'safe' ELSE 'warning' END END AS safety,
  CASE WHEN rank IS NOT NULL THEN pose_bin END AS crop_box FROM {name} LEFT JOIN r{name} USING (media_id))"""


RUNS = f"""WITH {OBS},{cand(0.05, 'a')},{cand(0.02, 'b', 1)},{run('a', 22)},{run('b', 26)},
r AS (SELECT media_id, a.face_count AS base_face_count, b.face_count AS candidate_face_count, a.similarity AS base_similarity, b.similarity AS candidate_similarity,
  round(b.similarity - a.similarity, 6) AS similarity_delta, coalesce(a.status, 'missing') AS base_status, coalesce(b.status, 'missing') AS candidate_status,
  coalesce(a.reason, 'missing') AS base_reason, coalesce(b.reason, 'missing') AS candidate_reason, a.rank AS base_rank, b.rank AS candidate_rank,
  a.strategy AS base_strategy, b.strategy AS candidate_strategy, a.safety AS base_safety, b.safety AS candidate_safety, a.crop_box AS base_crop_box, b.crop_box AS candidate_crop_box,
  a.face_count IS DISTINCT FROM b.face_count AS face_count_changed, a.status IS DISTINCT FROM b.status OR a.reason IS DISTINCT FROM b.reason AS status_changed,
  (a.rank IS NULL) <> (b.rank IS NULL) AS selection_changed,
  a.safety IS NOT NULL AND b.safety IS NOT NULL AND (a.strategy, a.safety, a.crop_box) IS DISTINCT FROM (b.strategy, b.safety, b.crop_box) AS crop_changed
  FROM xa a FULL JOIN xb b USING (media_id)),
s AS (SELECT count(*) AS images, count(similarity_delta) AS pairs, round(avg(similarity_delta), 6) AS mean_delta, round(median(similarity_delta), 6) AS median_delta, round(max(abs(similarity_delta)), 6) AS most_delta,
  count(*) FILTER (status_changed) AS status_changes, count(*) FILTER (face_count_changed) AS face_count_changes, count(*) FILTER (selection_changed) AS selection_changes,
  count(*) FILTER (crop_changed) AS crop_changes, count(*) FILTER (base_face_count > 0 AND candidate_face_count = 0) AS new_misses,
  count(*) FILTER (base_rank IS NOT NULL AND candidate_rank IS NOT NULL) AS overlap,
  round(count(*) FILTER (base_rank IS NOT NULL AND candidate_rank IS NOT NULL) / greatest(1, count(*) FILTER (base_rank IS NOT NULL)), 4) AS overlap_ratio,
  count(*) FILTER (base_safety LIKE 'safe%' AND candidate_safety NOT LIKE 'safe%') AS unsafe_regressions FROM r) """
TOP = """, top AS (SELECT media_id, row_number() OVER (ORDER BY similarity DESC, quality_score DESC, media_id) AS rank FROM c WHERE status = 'eligible' OR fallback_eligible QUALIFY rank <= 20) """
HASH = "list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END::HUGEINT)), lambda a, x: a * 2 + x)"
COMMON = "greatest(0, least(b.x2, y.x2) - greatest(b.x1, y.x1)) * greatest(0, least(b.y2, y.y2) - greatest(b.y1, y.y1))"
POINTS = [("100 + m % 7", "120 + m % 5"), ("160 + m % 9", "118 + m % 11"), ("128 + m % 13", "150 + m % 3"), ("105", "185"), ("155", "186")]


def start(total: str, size: str, low: str, high: str) -> str:
    middle = f"round_even(({low} + {high} - {size}) / 2, 0)"
    return f"CASE WHEN {high} - {low} <= {size} THEN greatest(0, ceil({high} - {size}), least({total} - {size}, floor({low}), {middle})) ELSE greatest(0, least({total} - {size}, {middle})) END"


RETAIN = FRAMES.replace("WITH f", "WITH RECURSIVE f") + """, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY seconds, id) AS k, {'n': -score, 's': seconds, 'i': id, 'h': id * 2654435761 % 4611686018427387904} AS x FROM f),
r AS (SELECT source, k, [x] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT source, k, CASE WHEN d IS NULL THEN list_sort(list_append(kept, x))[1:3] WHEN x.n < d.n THEN list_sort(list_append(list_filter(kept, lambda y: y.i <> d.i), x))[1:3] ELSE kept END
  FROM (SELECT o.source, o.k, r.kept, o.x, list_filter(r.kept, lambda y: abs(o.x.s - y.s) < 1.5 OR bit_count(xor(o.x.h, y.h)) <= 6)[1] AS d FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)),
e AS (SELECT source, kept FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1), z AS (SELECT source, unnest(kept) AS y FROM e)
SELECT source, y.i AS id, -y.n AS score FROM z"""


def greedy(name: str, count: int, also: str) -> str:
    """The greedy selection from eligible rows and those that `also` says, as a recursion over picks."""
    return f"""pool{name} AS (SELECT c.*, {HASH.replace('embedding', 'vector')} AS h FROM c WHERE status = 'eligible' OR {also}),
facts{name} AS (SELECT count(*) AS size, least(count(*) FILTER (body_focused), round_even(0.30 * least({count}, count(*)), 0)) AS quota FROM pool{name}),
sel{name} AS (SELECT 0 AS k, []::BIGINT[] AS ids, []::HUGEINT[] AS hs, []::VARCHAR[] AS sc, []::VARCHAR[] AS po, []::VARCHAR[] AS li, 0 AS met
UNION ALL SELECT k + 1, list_append(ids, media_id), list_append(hs, h), list_append(sc, scale_bin), list_append(po, pose_bin), list_append(li, light_bin), met + body_focused::INT FROM (
  SELECT *, round(CASE WHEN appearance IS NOT NULL THEN 0.90 ELSE 0.75 END * base + 0.22 / (1 + len(list_filter(sc, lambda y: y = scale_bin))) + 0.45 * 0.22 / (1 + len(list_filter(po, lambda y: y = pose_bin)))
    + CASE WHEN appearance IS NOT NULL THEN 0.02 ELSE 0.05 END / (1 + len(list_filter(li, lambda y: y = light_bin))), 9) AS u
  FROM sel{name}, pool{name}, facts{name} WHERE k < least({count}, size) AND NOT list_contains(ids, media_id) AND len(list_filter(hs, lambda y: bit_count(xor(y, h)) <= 6)) = 0)
  QUALIFY row_number() OVER (ORDER BY (met < (SELECT quota FROM facts{name}) AND body_focused) DESC, u DESC, similarity DESC, quality_score DESC, media_id) = 1),
done{name} AS (SELECT ids FROM sel{name} ORDER BY k DESC LIMIT 1)"""


def either(count: int) -> str:
    return f", best AS (SELECT CASE WHEN len(done.ids) >= {count} THEN done.ids ELSE donef.ids END AS ids FROM done, donef) SELECT unnest(ids) AS media_id, unnest(range(1, len(ids) + 1))::INT AS rank FROM best"


def oracle_sql() -> dict[str, str]:
    return {
        "q_cosine_to_centroid": C + "SELECT media_id, similarity FROM c",
        "q_weighted_centroid": f"WITH {OBS} SELECT label, pos::INT AS pos, round(s / n, 6) AS x FROM sums JOIN norms USING (label)",
        "q_outlier_filter": f"""WITH {OBS}, p AS (SELECT a.label, a.media_id, round(avg(list_cosine_similarity(a.vector, b.vector)), 6) AS mean_similarity
            FROM obs a JOIN obs b ON a.label = b.label AND a.media_id <> b.media_id WHERE a.media_id < 50 AND b.media_id < 50 GROUP BY 1, 2)
            SELECT label, media_id, mean_similarity, count(*) OVER g < 3 OR row_number() OVER (PARTITION BY label ORDER BY mean_similarity DESC, media_id) <= 2
              OR (mean_similarity >= 0.60 AND mean_similarity >= round(median(mean_similarity) OVER g - 0.15, 6)) AS kept FROM p WINDOW g AS (PARTITION BY label)""",
        "q_quality_bins": C + "SELECT media_id, quality_score, threshold, scale_bin, pose_bin, light_bin FROM c",
        "q_gate_reason": C + "SELECT media_id, status, reason, fallback_eligible FROM c",
        "q_selection_score": C + "SELECT media_id, base, body_focused FROM c",
        "q_distribution": C + "SELECT kind, value, count(*) AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce({k}, 'None') AS value FROM c" for k in ("status", "reason", "scale_bin", "pose_bin", "light_bin"))
        + ") GROUP BY kind, value",
        "q_pool_order": C + "SELECT media_id, similarity, quality_score FROM c WHERE status = 'eligible' OR fallback_eligible",
        "q_best_detection": DET + "SELECT d.image, min(tdet) AS det, max(score) AS score, count(*) AS n FROM d JOIN t USING (image) GROUP BY d.image",
        "q_overlap_review": DET + """, e AS (SELECT d.*, t.*, greatest(4, 0.40 * greatest(x2 - x1, y2 - y1)) AS p, greatest(4, 0.08 * greatest(a2 - a1, b2 - b1)) AS q FROM d JOIN t USING (image)),
            h AS (SELECT image, count(*) FILTER ((det <> tdet OR part <> tpart OR supp <> tsupp) AND x1 - p < a2 + q AND a1 - q < x2 + p AND y1 - p < b2 + q AND b1 - q < y2 + p) AS n_overlaps FROM e GROUP BY image)
            SELECT image, n_overlaps, CASE WHEN most < 0.5 THEN 'rejected' WHEN n_overlaps > 0 THEN 'multiple_faces_review' ELSE 'eligible' END AS status FROM h JOIN (SELECT image, max(score) AS most FROM d GROUP BY image) USING (image)""",
        "q_box_iou": DET + """, m AS (SELECT image, det, part, supp, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS common,
            (x2 - x1) * (y2 - y1) AS s, (a2 - a1) * (b2 - b1) AS r FROM d JOIN t USING (image))
            SELECT image, det, part, supp, round(common / greatest(1e-6, s + r - common), 6) AS iou FROM m""",
        "q_person_match": DET + """, m AS (SELECT image, (det * 1000000 + part) * 10000 + supp AS id, score, x1, y1, x2, y2, a1, b1, a2, b2, (a1 + a2) / 2 AS fx, (b1 + b2) / 2 AS fy, greatest(1, a2 - a1, b2 - b1) AS z,
            greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS common, (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) AS areas
            FROM d JOIN t USING (image) WHERE det <> tdet OR part <> tpart OR supp <> tsupp),
            w AS (SELECT *, round(4 * (common / greatest(1e-6, areas - common)) + exp(-0.5 * (sqrt((fx - (x1 + x2) / 2) ** 2 + (fy - (y1 + y2) / 2) ** 2) / z)) + 0.1 * score, 9) AS weight FROM m),
            b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY weight DESC, id) = 1)
            SELECT t.image, CASE WHEN fx BETWEEN x1 - z AND x2 + z AND fy BETWEEN y1 - z AND y2 + z THEN id END AS person FROM t LEFT JOIN b USING (image)""",
        "q_hamming_pairs": """WITH h AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END::HUGEINT)), lambda a, x: a * 2 + x) AS h FROM embeddings)
            SELECT a.vec_id AS "left", b.vec_id AS "right", bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 16""",
        "q_anti_reference": "SELECT vec_id AS media_id, label FROM embeddings WHERE vec_id >= 50",
        "q_topk_per_source": FRAMES + "SELECT source, id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 3",
        "q_sample_positions": FRAMES + """, s AS (SELECT source, floor(max(seconds)) - floor(min(seconds)) AS duration, count(*) AS frames FROM f GROUP BY source HAVING duration > 0),
            n AS (SELECT *, least(120, greatest(1, ceil(duration * 0.5)))::BIGINT AS n FROM s), x AS (SELECT *, unnest(range(n)) AS i FROM n),
            y AS (SELECT *, least(duration, (i + 0.5) * (duration / n)) AS spot FROM x)
            SELECT source, i, round(spot, 6) AS seconds, least(frames - 1, round_even(spot * (frames / duration), 0)::BIGINT) AS frame FROM y""",
        "q_style_plan": IMAGES + f""", p AS (SELECT *, CASE WHEN width * bh > height * bw THEN (height * bw) // bh ELSE width END AS cw,
            CASE WHEN width * bh > height * bw THEN height ELSE (width * bh) // bw END AS ch FROM i JOIN {SHAPES} s ON bw <= width AND bh <= height)
            SELECT image, bw::BIGINT AS bucket_width, bh::BIGINT AS bucket_height, (width - cw) // 2 AS x1, (height - ch) // 2 AS y1, (width - cw) // 2 + cw AS x2, (height - ch) // 2 + ch AS y2
            FROM p QUALIFY row_number() OVER (PARTITION BY image ORDER BY cw * ch DESC, bw * bh DESC, k) = 1""",
        "q_bucket_fit": IMAGES + f""", p AS (SELECT *, width // 2 AS cw, height // 2 AS ch, gcd(bw, bh) AS g FROM i, {SHAPES} s),
            m AS (SELECT *, greatest(g, ceil(cw / (bw // g)), ceil(ch / (bh // g)))::BIGINT AS x FROM p),
            w AS (SELECT *, x * (bw // g) AS ww, x * (bh // g) AS wh, round(abs(ln((bw / bh) / (cw / ch))), 9) AS miss FROM m)
            SELECT image, bw::BIGINT AS bucket_width, bh::BIGINT AS bucket_height, ww::BIGINT AS crop_width, wh::BIGINT AS crop_height FROM w WHERE ww <= width AND wh <= height
            QUALIFY row_number() OVER (PARTITION BY image ORDER BY miss, ww * wh, bw * bh DESC, k) = 1""",
        "q_label_summary": "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS labels, max(value) AS most FROM events GROUP BY user_id",
        "q_class_exclusion": "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 50)",
        "q_run_compare": RUNS + "SELECT * FROM r",
        "q_delta_stats": RUNS + "SELECT pairs, mean_delta, median_delta, most_delta, new_misses, round(greatest(0, least(1, 0.05 + median_delta)), 4) AS suggested_threshold FROM s",
        "q_decision_manifest": C + TOP + """SELECT media_id, CASE WHEN rank IS NOT NULL AND status = 'eligible' THEN 'selected_strong' WHEN rank IS NOT NULL THEN 'selected_fallback' WHEN status = 'eligible' THEN 'not_selected' ELSE reason END AS decision,
            CASE WHEN rank IS NOT NULL THEN lpad(rank::VARCHAR, 3, '0') || '_' || media_id || '.jpg' END AS file FROM c LEFT JOIN top USING (media_id)""",
        "q_config_digest": IMAGES + """SELECT image, sha256('{"backend": "stub", "height": ' || CASE WHEN image % 5 = 0 THEN 'null' ELSE height::VARCHAR END || ', "image": ' || image || ', "sample_fps": 0.5, "width": ' || width || '}') AS digest FROM i""",
        "q_incremental_misses": IMAGES + "SELECT image, width, height FROM i WHERE image % 3 = 0 OR image % 5 = 0",
        "q_vote_class": f"""WITH {OBS}, v AS (SELECT *, list_filter([appearance, body_confidence, CASE WHEN media_id % 2 = 0 THEN exposure END], lambda x: x IS NOT NULL) AS s FROM obs),
            l AS (SELECT *, CASE WHEN len(s) = 0 THEN 'unknown' WHEN list_sum(s) / len(s) > 0.55 THEN 'high' WHEN list_sum(s) / len(s) > 0.28 THEN 'medium' ELSE 'low' END AS level FROM v)
            SELECT media_id, level, CASE WHEN luma < 0.40 THEN 'unknown' ELSE level END AS sure_level,
              CASE WHEN greatest(exposure, margin, luma) <= 0.4 THEN 'none' WHEN exposure >= margin AND exposure >= luma THEN 'first' WHEN margin >= luma THEN 'second' ELSE 'third' END AS most,
              CASE WHEN appearance IS NULL THEN 'unknown' WHEN appearance <= 0.3 THEN 'narrow' WHEN appearance BETWEEN 0.35 AND 0.6 THEN 'even' WHEN appearance BETWEEN 0.65 AND 1 THEN 'wide' ELSE 'between' END AS ratio FROM l""",
        "q_set_ops": """WITH o AS (SELECT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer), x AS (SELECT 'both' AS op, k FROM (SELECT k FROM o INTERSECT SELECT k FROM c)
            UNION ALL SELECT 'only_customer', k FROM (SELECT k FROM c EXCEPT SELECT k FROM o) UNION ALL SELECT 'any', k FROM (SELECT k FROM o UNION SELECT k FROM c))
            SELECT op, count(*) AS n, sum(k)::BIGINT AS total FROM x GROUP BY op""",
        "q_window_counts": """SELECT epoch(time_bucket(INTERVAL 5 MINUTES, ts))::BIGINT AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""",
        "q_scorer_hook": C + "SELECT media_id, CASE WHEN status = 'eligible' THEN round(quality_score * 0.5 + media_id % 2 * 0.25, 6) END AS score FROM c",
        "q_acceptance": RUNS + """SELECT *, 1.25::DOUBLE AS speedup, new_misses = 0 AS no_new_misses, unsafe_regressions = 0 AS no_unsafe_regressions, overlap_ratio >= 0.90 AS enough_overlap, TRUE AS enough_speedup,
            round(greatest(0, least(1, 0.05 + median_delta)), 4) AS suggested_threshold FROM s""",
        "q_summary": C + TOP + """, k AS (SELECT 'status' AS kind, status AS value FROM c UNION ALL SELECT unnest(['scale_bin', 'pose_bin', 'light_bin']), unnest([scale_bin, pose_bin, light_bin]) FROM c JOIN top USING (media_id))
            SELECT 20 AS requested, (SELECT count(*) FROM top) AS selected, 0::BIGINT AS multiple_faces_review, (SELECT count(*) FROM c WHERE status = 'rejected') AS rejected, kind, value, count(*) AS n FROM k GROUP BY kind, value""",
        "q_contact_labels": C + TOP + "SELECT rank, printf('%d: %s, %s', rank, scale_bin, pose_bin) || chr(10) || printf('sim=%.3f', similarity) AS label, (rank - 1) // 4 AS row, (rank - 1) % 4 AS place FROM c JOIN top USING (media_id)",
        "q_greedy_select": f"WITH RECURSIVE {OBS},{cand(0.05, 'c')}, {greedy('', 20, 'FALSE')}, {greedy('f', 20, 'fallback_eligible')} {either(20)}",
        "q_fill_select": f"WITH RECURSIVE {OBS},{cand(0.05, 'c')}, {greedy('', 150, 'FALSE')}, {greedy('f', 150, 'fallback_eligible')} {either(150)}",
        "q_suppress": DET.replace("WITH d", "WITH RECURSIVE d") + f""", o AS (SELECT image, (det * 1000000 + part) * 10000 + supp AS id, score, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b, row_number() OVER (PARTITION BY image ORDER BY score DESC, (det * 1000000 + part) * 10000 + supp) AS k FROM d),
            r AS (SELECT image, k, [b] AS kept, id, score, TRUE AS stays FROM o WHERE k = 1 UNION ALL
              SELECT image, k, CASE WHEN hit = 0 THEN list_append(kept, b) ELSE kept END, id, score, hit = 0 FROM (SELECT o.image, o.k, o.id, o.score, o.b, r.kept,
                len(list_filter(r.kept, lambda y: {COMMON.replace('b.', 'o.b.')} / greatest(1e-6, (o.b.x2 - o.b.x1) * (o.b.y2 - o.b.y1) + (y.x2 - y.x1) * (y.y2 - y.y1) - {COMMON.replace('b.', 'o.b.')}) >= 0.30)) AS hit
                FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1))
            SELECT image, id, score FROM r WHERE stays""",
        "q_video_retain": RETAIN,
        "q_stream_retain": RETAIN,
        "q_stream_window": """SELECT epoch(time_bucket(INTERVAL 5 MINUTES, ts))::BIGINT AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""",
        "q_detect_rows": IMAGES + """, j AS (SELECT *, unnest(range(image % 4)) AS j, image % 29 = 0 AND image % 4 > 1 AS broken FROM i)
            SELECT image, CASE WHEN broken THEN -1 ELSE j END::INT AS det, CASE WHEN broken THEN 'ValueError: image ' || image END AS error, CASE WHEN NOT broken THEN (image * 31 + j * 17) % 1000 / 1000 END AS score,
              CASE WHEN NOT broken THEN j * 50 + image % 97 END::DOUBLE AS x1, CASE WHEN NOT broken THEN image % 53 END::DOUBLE AS y1,
              CASE WHEN NOT broken THEN least(width, j * 50 + image % 97 + 40 + j) END::DOUBLE AS x2, CASE WHEN NOT broken THEN least(height, image % 53 + 60) END::DOUBLE AS y2 FROM j WHERE NOT broken OR j = 0""",
        "q_decode_classes": f"""WITH RECURSIVE t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, k: CASE WHEN k <= 16 THEN 160 + 600 * x WHEN k <= 32 THEN 40 + 300 * abs(x) ELSE least(1.0, 3 * abs(x)) END) AS x FROM embeddings),
            b AS (SELECT vec_id, unnest(range(8)) AS i, x FROM t),
            s AS (SELECT vec_id, i, x[1 + i] AS cx, x[9 + i] AS cy, x[17 + i] / 2 AS w, x[25 + i] / 2 AS h, [x[33 + i], x[41 + i], x[49 + i], x[57 + i]] AS c FROM b),
            d AS (SELECT vec_id, i, list_position(c, list_max(c)) - 1 AS class_id, list_max(c) AS score, {{'x1': greatest(0, round_even((cx - w - 10) / 0.8::DOUBLE, 0)), 'y1': greatest(0, round_even((cy - h - 6) / 0.8::DOUBLE, 0)),
              'x2': least(300, round_even((cx + w - 10) / 0.8::DOUBLE, 0)), 'y2': least(280, round_even((cy + h - 6) / 0.8::DOUBLE, 0))}} AS b FROM s),
            o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS k FROM d WHERE score >= 0.25 AND b.x2 > b.x1 AND b.y2 > b.y1),
            r AS (SELECT vec_id, k, [b] AS kept, class_id, score, b, TRUE AS stays FROM o WHERE k = 1 UNION ALL
              SELECT vec_id, k, CASE WHEN hit = 0 THEN list_append(kept, b) ELSE kept END, class_id, score, b, hit = 0 FROM (SELECT o.vec_id, o.k, o.class_id, o.score, o.b, r.kept,
                len(list_filter(r.kept, lambda y: {COMMON.replace('b.', 'o.b.')} / greatest(1e-6, (o.b.x2 - o.b.x1) * (o.b.y2 - o.b.y1) + (y.x2 - y.x1) * (y.y2 - y.y1) - {COMMON.replace('b.', 'o.b.')}) > 0.45)) AS hit
                FROM r JOIN o ON o.vec_id = r.vec_id AND o.k = r.k + 1))
            SELECT vec_id, class_id::INT AS class_id, score, b.x1 + 100 AS x1, b.y1 + 50 AS y1, b.x2 + 100 AS x2, b.y2 + 50 AS y2 FROM r WHERE stays""",
        "q_sample_frames": FRAMES + """, d AS (SELECT source, floor(min(seconds)) AS start, floor(max(seconds)) - floor(min(seconds)) AS duration FROM f GROUP BY source),
            n AS (SELECT *, least(120, greatest(1, ceil(duration * 0.5)))::BIGINT AS n FROM d WHERE duration > 0), p AS (SELECT *, unnest(range(n)) AS i FROM n),
            a AS (SELECT source, start, i, least(duration, (i + 0.5::DOUBLE) * (duration / n)) AS mid FROM p), r AS (SELECT source, id, seconds - start AS rel, duration FROM f JOIN d USING (source)),
            near AS (SELECT a.source, a.i, a.mid, rel, r.id FROM a JOIN r ON a.source = r.source QUALIFY row_number() OVER (PARTITION BY a.source, a.i ORDER BY abs(mid - rel), rel, r.id) = 1),
            still AS (SELECT source, rel, id, row_number() OVER (PARTITION BY source ORDER BY rel, id) - 1 AS k FROM r WHERE duration = 0)
            SELECT source, i, round(mid, 6) AS at, round(rel, 6) AS seconds, id FROM near UNION ALL SELECT source, k // 30, round(rel, 6), round(rel, 6), id FROM still WHERE k % 30 = 0 AND k < 3600""",
        "q_near_frames": FRAMES + """SELECT a.source, a.id AS "left", b.id AS "right", round(b.seconds - a.seconds, 6) AS gap FROM f a JOIN f b ON a.source = b.source AND b.seconds - a.seconds < 1800 AND (b.seconds, b.id) > (a.seconds, a.id)""",
        "q_grid_signals": """WITH p AS (SELECT vec_id, unnest(range(288)) AS k, embedding::DOUBLE[] AS e FROM embeddings),
            g AS (SELECT vec_id, k // 18 AS y, k % 18 AS x, greatest(0, least(255, floor(128 + 400 * e[(k // 18 * 18 + k % 18 * 7) % 64 + 1])))::INT AS v FROM p),
            s AS (SELECT vec_id, y // 2 AS r, x // 2 AS c, round_even(sum(v) / 4, 0) AS v FROM g GROUP BY ALL),
            b AS (SELECT a.vec_id, a.r * 8 + a.c AS k, (b.v >= a.v)::BIGINT AS bit FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.r = b.r AND b.c = a.c + 1),
            h AS (SELECT vec_id, (sum(bit::HUGEINT * (1::HUGEINT << (63 - k)::INT)) - CASE WHEN max(CASE WHEN k = 0 THEN bit END) = 1 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS hash FROM b GROUP BY vec_id),
            n AS (SELECT vec_id, y, x, v, unnest([[y, abs(x - 1)], [y, 17 - abs(17 - x - 1)], [abs(y - 1), x], [15 - abs(15 - y - 1), x]]) AS o FROM g),
            l AS (SELECT n.vec_id, n.y, n.x, sum(g.v) - 4 * any_value(n.v) AS d FROM n JOIN g ON g.vec_id = n.vec_id AND g.y = n.o[1] AND g.x = n.o[2] GROUP BY ALL)
            SELECT vec_id, hash, round(blur, 6) AS blur FROM h JOIN (SELECT vec_id, ln(1 + var_pop(d)) AS blur FROM l GROUP BY vec_id) USING (vec_id)""",
        "q_sidecars": """WITH c AS (SELECT lpad(conv_id::VARCHAR, 9, '0') || '.txt' AS name, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)
            SELECT name, sha256(text) AS sha256, length(text) AS n_chars FROM c""",
        "q_scorer_stages": C + """, s AS (SELECT media_id, CASE WHEN similarity >= round(threshold - 0.15, 6) AND quality_score >= 0.3 THEN round(quality_score * 0.5 + media_id % 2 * 0.25, 6) END AS look, coalesce(body_confidence, 0) AS confidence FROM c)
            SELECT media_id, look, CASE WHEN confidence >= 0.5 THEN round(look + confidence, 6) END AS body, NULL::VARCHAR AS stage_error FROM s""",
        "q_stream_sources": IMAGES + """, r AS (SELECT image, width * height AS bytes, image % 13 = 0 AS broken, image % 3 + 1 AS m FROM i)
            SELECT image, CASE WHEN broken THEN 'error' ELSE 'ok' END AS status, CASE WHEN broken THEN 'ValueError: source ' || image || ' breaks off' END AS error,
              CASE WHEN broken THEN 0 ELSE m END AS n, CASE WHEN NOT broken THEN (bytes * (m * (m + 1) / 2))::DOUBLE END AS total FROM r""",
        "q_stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
        "q_mean_centroid": f"""WITH {OBS}, u AS (SELECT label, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM obs WHERE media_id < 50),
            p AS (SELECT label, unnest(range(len(vector)))::INT AS pos, unnest(vector) / n AS x FROM u), m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY label, pos)
            SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
        "q_reference_centroid": f"""WITH {OBS}, p AS (SELECT a.label, a.media_id, round(avg(list_cosine_similarity(a.vector, b.vector)), 6) AS m FROM obs a JOIN obs b ON a.label = b.label AND a.media_id <> b.media_id WHERE a.media_id < 50 AND b.media_id < 50 GROUP BY 1, 2),
            k AS (SELECT media_id FROM p WINDOW g AS (PARTITION BY label) QUALIFY count(*) OVER g < 3 OR row_number() OVER (PARTITION BY label ORDER BY m DESC, media_id) <= 2 OR (m >= 0.60 AND m >= round(median(m) OVER g - 0.15, 6))),
            y AS (SELECT label, unnest(range(len(vector)))::INT AS pos, unnest(vector) AS x, greatest(q, 0.01) AS w FROM qual JOIN k USING (media_id)), z AS (SELECT label, pos, sum(x * w) AS s FROM y GROUP BY label, pos)
            SELECT label, pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS x FROM z""",
        "q_session_status": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' WHEN o_orderkey % 25 < 20 THEN 'completed_with_skips' WHEN o_custkey % 3 = 2 THEN 'completed_with_replacements'
            WHEN o_custkey % 3 = 1 THEN 'completed_after_tighter_crop' ELSE 'completed' END AS status FROM orders""",
        "q_unique_names": IMAGES + """SELECT image, CASE WHEN row_number() OVER (PARTITION BY image % 500 ORDER BY '/in/' || image) = 1 THEN 'IMG' || image % 500 || '.jpg'
            ELSE 'IMG' || image % 500 || '_' || left(sha256('/in/' || image), 10) || '.jpg' END AS file FROM i""",
        "q_source_state": IMAGES + """SELECT count(*) AS found, count(*) FILTER (width % 4 <> 0 AND width % 5 <> 0) AS reused, count(*) FILTER ((width % 4 = 0 OR width % 5 = 0) AND width % 3 <> 0) AS processed,
            count(*) FILTER ((width % 4 = 0 OR width % 5 = 0) AND width % 3 = 0) AS failed FROM i""",
        "q_bucket_geometry": IMAGES + f""", p AS (SELECT *, floor(width / 3) AS x1, floor(height / 3) AS y1, floor(2 * width / 3) AS x2, floor(2 * height / 3) AS y2, gcd(bw, bh) AS g FROM i, {SHAPES} s),
            q AS (SELECT *, x2 - x1 AS cw, y2 - y1 AS ch, bw // g AS uw, bh // g AS uh, round(abs(ln((bw / bh) / ((x2 - x1) / (y2 - y1)))), 9) AS miss FROM p),
            a AS (SELECT *, greatest(g, ceil(cw / uw), ceil(ch / uh)) AS m FROM q),
            b AS (SELECT *, m * uw AS ww, m * uh AS wh, least(greatest(0, (x1 + x2) / 2 - m * uw / 2), width - m * uw) AS l, least(greatest(0, (y1 + y2) / 2 - m * uh / 2), height - m * uh) AS t FROM a),
            c AS (SELECT image, 0 AS pri, miss AS k1, ww * wh / greatest(1, cw * ch) AS k2, -bw * bh AS k3, 0 AS k4, k, bw, bh, round_even(l, 0) AS x, round_even(t, 0) AS y, round_even(l + ww, 0) - round_even(l, 0) AS w, round_even(t + wh, 0) - round_even(t, 0) AS h FROM b
              WHERE ww <= width AND wh <= height AND round_even(l, 0) <= x1 AND round_even(t, 0) <= y1 AND round_even(l + ww, 0) >= x2 AND round_even(t + wh, 0) >= y2),
            d AS (SELECT *, least(width // uw, height // uh) AS m FROM q), e AS (SELECT *, m * uw AS ww, m * uh AS wh FROM d WHERE m >= g),
            f AS (SELECT *, greatest(0, ceil(x2 - ww)) AS xl, least(width - ww, x1) AS xh, greatest(0, ceil(y2 - wh)) AS yl, least(height - wh, y1) AS yh FROM e),
            n AS (SELECT *, least(greatest(round_even((x1 + x2) / 2 - ww / 2, 0), xl), xh) AS l, least(greatest(round_even((y1 + y2) / 2 - wh / 2, 0), yl), yh) AS t FROM f WHERE xl <= xh AND yl <= yh),
            o AS (SELECT image, 1 AS pri, -round(greatest(0, least(l + ww, x2) - greatest(l, x1)) * greatest(0, least(t + wh, y2) - greatest(t, y1)) / greatest(1, cw * ch), 9) AS k1, miss AS k2, -ww * wh AS k3, -bw * bh AS k4, k, bw, bh, l AS x, t AS y, ww AS w, wh AS h FROM n),
            best AS (SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM o) QUALIFY row_number() OVER (PARTITION BY image ORDER BY pri, k1, k2, k3, k4, k) = 1)
            SELECT i.image, bw::INT AS bucket_width, bh::INT AS bucket_height, x::DOUBLE AS x1, y::DOUBLE AS y1, w::DOUBLE AS crop_width, h::DOUBLE AS crop_height FROM i LEFT JOIN best USING (image)""",
        "q_style_focus": IMAGES + f""", p AS (SELECT *, CASE WHEN width * bh > height * bw THEN floor(height * bw / bh) ELSE width END::DOUBLE AS cw, CASE WHEN width * bh > height * bw THEN height ELSE floor(width * bh / bw) END::DOUBLE AS ch,
            least(width, height) * 0.025 AS m FROM i JOIN {SHAPES} s ON bw <= width AND bh <= height),
            f AS (SELECT *, greatest(0, width / 2 - m) AS l, least(width, width * 0.75 + m) AS r, greatest(0, height / 4 - m) AS t, least(height, height / 2 + m) AS b FROM p),
            x AS (SELECT *, CASE WHEN image % 4 = 0 THEN floor((width - cw) / 2) ELSE {start('width', 'cw', 'l', 'r')} END AS x1, CASE WHEN image % 4 = 0 THEN floor((height - ch) / 2) ELSE {start('height', 'ch', 't', 'b')} END AS y1 FROM f)
            SELECT image, bw::INT AS bucket_width, bh::INT AS bucket_height, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x1 + cw AS x2, y1 + ch AS y2, printf('%.2f', 100 * (cw * ch) / (width * height)) AS kept
            FROM x QUALIFY row_number() OVER (PARTITION BY image ORDER BY cw * ch DESC, bw * bh DESC, k) = 1""",
        "q_box_signals": DET + """, w AS (SELECT *, greatest(x2 - x1, y2 - y1) * 1.6 / 2 AS half, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 + 0.1 * (y2 - y1) AS cy FROM d)
            SELECT image, det, part, supp, greatest(0, least(1200, x2) - greatest(0, x1))::DOUBLE AS visible, round(greatest(0, least(1, least(x1, y1, 1200 - x2, 1000 - y2) / greatest(1e-9, 0.20 * (x2 - x1)))), 6)::DOUBLE AS margin,
              round(least(1, (x2 - x1) * 1.5 / 160), 6)::DOUBLE AS resolution, round(greatest(0, 1 - 2 * (score / 4)) * greatest(0, 1 - abs(score - 0.5)), 7)::DOUBLE AS exposure, greatest(0, round_even(cx - half, 0))::DOUBLE AS sx1,
              greatest(0, round_even(cy - half, 0))::DOUBLE AS sy1, least(1200, round_even(cx + half, 0))::DOUBLE AS sx2, least(1000, round_even(cy + half, 0))::DOUBLE AS sy2, x2 * 2 AS bx2, y2 * 1.5 AS by2 FROM w""",
        "q_box_hull": DET + "SELECT image, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM d GROUP BY image",
        "q_frame_gate": FRAMES + """, g AS (SELECT *, score / 100 AS s, (20 + id % 200)::DOUBLE AS w FROM f)
            SELECT source, id, round(0.70 * s + 0.25 * 0.5 + 0.05 * least(1, w / 160), 7) AS frame_score, 'clip_' || source || '_' || left(sha256('/v/' || source), 10) || '_' || lpad((id * 1000)::VARCHAR, 10, '0') || '.jpg' AS file
            FROM g WHERE s >= 0.55 - 0.15 AND w >= 48 AND w / 1000 >= 0.04""",
        "q_early_reasons": IMAGES + """SELECT image, CASE WHEN image % 11 = 0 THEN 'unreadable' WHEN image % 13 = 0 THEN 'backend_error: out of memory' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = image) THEN 'no_face' END AS reason FROM i""",
        "q_landmark_pose": "WITH p AS (SELECT vec_id AS m, " + ", ".join(f"CASE WHEN vec_id % 12 = 0 THEN 100 ELSE {x.replace('m %', 'vec_id %')} END::DOUBLE AS x{i}, CASE WHEN vec_id % 12 = 0 THEN 100 ELSE {y.replace('m %', 'vec_id %')} END::DOUBLE AS y{i}" for i, (x, y) in enumerate(POINTS)) + """ FROM embeddings),
            q AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS wide, (x0 + x1) * 0.5 AS ex, (y0 + y1) * 0.5 AS ey, (x3 + x4) * 0.5 AS mx, (y3 + y4) * 0.5 AS my FROM p), s AS (SELECT *, wide >= 1 AND abs(my - ey) >= 1 AS sound FROM q)
            SELECT m AS media_id, CASE WHEN sound THEN round(greatest(-75, least(75, (x2 - (ex + mx) * 0.5) / wide * 90)), 6) END AS yaw, CASE WHEN sound THEN round(greatest(-45, least(45, ((y2 - ey) / (my - ey) - 0.5) * 90)), 6) END AS pitch,
              CASE WHEN sound THEN round(degrees(atan2(y1 - y0, x1 - x0)), 6) END AS roll FROM s""",
        "q_label_ratios": "SELECT l_orderkey AS image, l_returnflag AS label, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) AS ratio FROM lineitem GROUP BY 1, 2",
        "q_buckets_parsed": IMAGES + ", b AS (SELECT image, width - width % 256 AS w, height - height % 256 AS h FROM i), o AS (SELECT *, image % 9 <> 0 AND w IN (512, 768, 1024) AND h IN (512, 768, 1024) AS ok FROM b) SELECT image, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height FROM o",
        "q_frame_provenance": FRAMES + "SELECT vec_id AS media_id, source, round(seconds, 3) AS seconds FROM embeddings LEFT JOIN f ON f.id = vec_id AND f.id % 2 = 0",
        "q_capped_size": IMAGES + "SELECT image, greatest(1, round_even(width * least(1.0::DOUBLE, 960::DOUBLE / greatest(width, height)), 0))::BIGINT AS width, greatest(1, round_even(height * least(1.0::DOUBLE, 960::DOUBLE / greatest(width, height)), 0))::BIGINT AS height FROM i",
    }
