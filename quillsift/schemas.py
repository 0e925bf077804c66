"""Declared schemas of the library's files; nothing is inferred."""

PATIENT_MANIFEST = "image_name string, path string, patient_id string, category string, clinical_diagnosis string, split string"
EXTERNAL_MANIFEST = "path string, category string, subject_id string, lesion_present int, excluded_from_metrics boolean, exclusion_reason string"
CLUSTER_MANIFEST = "path string, label string, cluster_id int, split string"
EXCLUSIONS = "dataset string, path string, reason string, counterpart_dataset string, counterpart_path string, evidence_ncc double, evidence_ransac_inliers int, phash_threshold int, verified_on date"
QUALITY_FLAGS = "path string, source_class string, score double, clip_frac double, local_entropy double"
HASH_CACHE = "map<string, struct<root:string, n_images:int, n_failed:int, entries:array<struct<path:string, md5:string, phash:string>>>>"
PAIR_TRUTH = "source_image string, source_class string, homography array<array<double>>, lesion_change struct<center_xy:array<int>, radius_px:int, darken_factor:double, enlarge_factor:double>"
PHOTOS = "id long, filename string, captured_ms long, width int, height int"
ANNOTATIONS = "images array<struct<id:long, file_name:string>>, annotations array<struct<image_id:long, category_id:long, segmentation:string>>, categories array<struct<id:long, name:string>>"
