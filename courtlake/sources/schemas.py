"""Fixed schemas of the nested documents, as DDL."""

POINT = "struct<t:double,x:double,y:double,confidence:double,source:string>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double,confidence:double,track_id:bigint>"
KEYPOINT = "struct<x:double,y:double,confidence:double>"
SHOT = "struct<t0:double,t1:double,speed_kmh:double,speed_at_net_kmh:double,residual_px:double,samples:array<struct<t:double,x:double,y:double,z:double>>>"
VISION = (
    "struct<status:string,camera_mode:string,shuttle_quality:double,player_quality:double,pose_quality:double,racquet_quality:double,"
    f"mask_enabled:boolean,shuttle_engine:string,shuttle:array<{POINT}>,players:array<struct<t:double,boxes:array<{BOX}>>>,"
    f"poses:array<struct<t:double,people:array<struct<id:bigint,track_id:bigint,confidence:double,keypoints:array<{KEYPOINT}>>>>>>"
)
RALLY = (
    "struct<start:double,`end`:double,dur:double,clip_dur:double,src_start:double,intensity:bigint,note:string,render_window:array<double>,trimmed:boolean,"
    "camera_path:array<struct<t:double,x:double,y:double,w:double,h:double>>,"
    f"rally_3d:struct<status:string,message:string,rejected:map<string,bigint>,shots:array<{SHOT}>>,vision:{VISION}>"
)
RESULT = (
    "job_id string, sport string, duration double, "
    "all_rallies array<struct<start:double,`end`:double,dur:double,intensity:bigint,note:string,used:boolean>>, "
    f"rallies array<{RALLY}>, "
    "court struct<status:string,corners:array<array<double>>,homography:array<double>,net:array<double>,confidence:double,source:string>, "
    "source struct<w:bigint,h:bigint,fps:double,duration:double>, "
    "audio struct<status:string,hop_s:double,series:array<array<double>>,peaks:array<struct<t:double,db:double,prominence_db:double>>>"
)
LABELS = (
    "clip string, fps double, rallies array<struct<rally:bigint,shuttle:array<struct<t:double,x:double,y:double,visible:boolean>>,"
    "players:array<struct<t:double,boxes:array<struct<id:string,x:double,y:double>>>>,"
    "pose:array<struct<t:double,people:array<struct<id:bigint,bbox:struct<x:double,y:double,w:double,h:double>,keypoints:array<struct<x:double,y:double>>>>>>,"
    "shots3d:array<struct<t_hit:double,landing_xy_m:array<double>,speed_kmh:double>>>>"
)
MANIFEST = "name string, result string, labels string"
