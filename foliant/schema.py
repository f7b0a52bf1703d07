"""Row schemas of the engine's tables, as DDL.  Rectangles are four doubles with y upwards."""

RECT = "left double, top double, right double, bottom double"
SPANS = f"doc_id long, span_seq long, page int, text string, font_name string, font_size double, is_bold boolean, is_italic boolean, {RECT}"
PATHS = f"doc_id long, page int, {RECT}, path_type string, line_width double"
IMAGES = f"doc_id long, image_seq long, page int, path string, {RECT}, width_px int, height_px int, format string"
PAGES_DIM = "doc_id long, page int, width double, height double"
TABLE_REGIONS = f"doc_id long, table_seq long, page int, {RECT}, block_ids array<long>, caption_index long, caption_number int, caption_text string, has_rules boolean"
CHUNKS = "doc_id long, chunk_id long, section string, page_start int, page_end int, text string, estimated_tokens long, has_continuation boolean, section_ids array<long>"
