"""Declared schemas of the stored and in-flight tables (DDL strings, read with ``spark.read.schema``)."""

TABLES = {
    "users": "id string, email string, name string, is_admin boolean, is_active boolean, created_at timestamp",
    "countries": "id string, code string, name_ar string, name_en string, is_active boolean",
    "sources": "id string, name string, domain string, country_id string, category string, logo_url string, "
               "is_verified boolean, is_active boolean",
    "keywords": "id string, user_id string, keyword string, category string, is_active boolean, created_at timestamp",
    "searches": "id string, user_id string, search_type string, query string, image_url string, image_hash string, "
                "image_phash string, result_count int, processing_time_ms int, raw_response string, created_at timestamp",
    "search_results": "search_id string, url string, title string, snippet string, thumbnail_url string, domain string, "
                      "published_at timestamp, confidence double, rank int",
    "analyses": "id string, user_id string, analysis_type string, service string, media_url string, media_hash string, "
                "media_phash string, is_ai_generated boolean, confidence_ai double, confidence_human double, "
                "verdict string, generator string, detailed_results string, created_at timestamp",
    "analysis_frames": "analysis_id string, frame_number int, timestamp_seconds double, confidence double",
    "image_vectors": "media_hash string, phash bigint, dhash bigint, embedding array<float>, dim int, model string, "
                     "source string, ref_url string, created_at timestamp",
    "provider_calls": "id string, provider string, url string, method string, status_code int, ok boolean, "
                      "latency_ms double, error string, created_at timestamp",
    "user_files": "id string, user_id string, filename string, file_type string, mime_type string, file_size bigint, "
                  "download_count int, created_at timestamp",
}

IN_FLIGHT = {
    "responses": "inv_id string, label string, engine string, copy_id int, status int, body string",
    "answers": "inv_id string, label string, engine string, status string, credits int, note string, copy_id int, "
               "n_candidates bigint, pos bigint",
    "matches": "inv_id string, pos bigint, engine string, copy_id int, link string, title string, thumbnail string, "
               "image_url string, match_type string, date string, crawl_date string, first_indexed string, score double",
    "candidates": "inv_id string, pos bigint, url string, title string, thumb string, image_url string, engine string, "
                  "copy_id int, match string, crawl_date string, first_indexed string, engine_date string",
    "pages": "inv_id string, url string, html string, last_modified string, tweet_created_at string, crawl_date string",
    "captures": "url string, timestamp string, statuscode string",
    "copies": "inv_id string, id int, url string, phash bigint, width int, height int, source string, found_on string, "
              "searched array<string>",
}
