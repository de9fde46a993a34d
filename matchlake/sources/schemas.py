"""Schemas of a game's logs, as DDL. Frames are closed ranges, seconds are doubles, null means unknown."""

from __future__ import annotations

STATUS = "fps DOUBLE, total_frames BIGINT, rallies ARRAY<STRUCT<rally_index BIGINT, start_frame BIGINT, end_frame BIGINT, start_time_s DOUBLE, end_time_s DOUBLE, duration_s DOUBLE, segment_id STRING, segment_order INT>>, segments ARRAY<STRUCT<state STRING, start_frame BIGINT, end_frame BIGINT, start_time_s DOUBLE, end_time_s DOUBLE>>"
BALL = "frame_idx BIGINT, confidence DOUBLE, interpolated BOOLEAN, pixel ARRAY<DOUBLE>, court ARRAY<DOUBLE>, height_m DOUBLE, real_units BOOLEAN, speed_m_per_s DOUBLE, speed_px_per_s DOUBLE"
POSITIONS = "frame_idx BIGINT, timestamp_s DOUBLE, players ARRAY<STRUCT<stable_id BIGINT, box ARRAY<DOUBLE>, pixel ARRAY<DOUBLE>, court ARRAY<DOUBLE>, court_ground ARRAY<DOUBLE>, team STRING, likely_non_player BOOLEAN>>"
ACTIONS = "frame_idx BIGINT, timestamp_s DOUBLE, rally_index BIGINT, player_stable_id BIGINT, action_type STRING, action_type_confidence DOUBLE, action_box ARRAY<DOUBLE>, ball_pixel ARRAY<DOUBLE>, ball_court ARRAY<DOUBLE>, ball_height_m DOUBLE, speed_in_m_per_s DOUBLE, speed_out_m_per_s DOUBLE, real_units BOOLEAN, time_since_prev_touch_s DOUBLE, contact_refined BOOLEAN"
JOB = "id STRING, original_filename STRING, created_at STRING, updated_at STRING, status STRING, stage STRING, completed_stages ARRAY<STRING>, stage_durations_s MAP<STRING,DOUBLE>, processed_at STRING, error STRING, duration_s DOUBLE, date_played STRING"
NAMES = "MAP<STRING,STRING>"
SCORE_CONFIG = "method STRING, team_x_id STRING, team_y_id STRING, invert_side BOOLEAN, match_alternating_sides BOOLEAN, ocr_min_confidence DOUBLE, confirmed BOOLEAN"
