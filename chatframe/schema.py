"""Schemas of the tables that pass between operators."""

CONVERSATION = "conv_id bigint, raw string"
REACTION = "struct<name:string,count:int>"
MESSAGE = f"conv_id bigint, msg_idx int, username string, ts_text string, text string, msg_date timestamp, avatar string, thread_info string, reactions array<{REACTION}>, is_thread_reply boolean, is_thread_start boolean, is_edited boolean, start_line int, end_line int"
STATS = "conv_id bigint, message_count bigint, unique_users bigint, thread_replies bigint, format string"
RENDERED = "conv_id bigint, markdown string"
UNKNOWN_USER = "Unknown User"
