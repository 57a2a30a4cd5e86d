"""Record shapes of the motion tables, as DDL strings."""

VIDEOS = "video_id bigint, title string, url string, fps double, accessed timestamp, request string"
SCENES = "video_id bigint, scene_id int, start_s double, end_s double"
SEGMENTS = "video_id bigint, name string, start_s double, end_s double, flags array<string>"
KEYPOINTS = "array<struct<x:double,y:double,conf:double>>"
DETECTIONS = f"video_id bigint, frame int, track_id int, x double, y double, w double, h double, conf double, keypoints {KEYPOINTS}"
FRAME_SIGNALS = "video_id bigint, frame int, flow double, n_persons int, max_area double, human boolean"
BODIES = (
    "video_id bigint, scene_id int, body_id int, frame int, vitpose array<struct<x:float,y:float,conf:float>>, "
    "trans array<float>, cam_transl array<float>, pose array<float>, betas array<float>, bbox_xyxy array<float>, "
    "contacts array<float>, flagged boolean, fps int"
)
FACES = (
    "video_id bigint, scene_id int, face_id int, frame int, bbox array<float>, nose_2d array<struct<x:float,y:float>>, "
    "leye_2d array<struct<x:float,y:float>>, reye_2d array<struct<x:float,y:float>>, jaw array<float>, exp array<float>, "
    "emotion string, emotions_conf array<float>, shape array<float>"
)
CLIPS = "video_id bigint, scene_id int, body_id int, fps int, original_fps int, start int, stop int, gender string, model string"
CAPTIONS = "video_id string, scene_id string, text string"
CAPTION_ITEMS = "video_id string, scene_id string, person_id string, body_desc string, style string, action string"
JOINTS = "clip_id string, frame int, joint int, x double, y double, z double"
FEATURES = "clip_id string, frame int, vec array<float>"
FEATURE_STATS = "dim int, mean double, std double"
LEDGER_EVENTS = "item string, folder string, owner string, state string, ts timestamp, error string"
HEARTBEATS = "owner string, folder string, ts timestamp, items array<string>"
