"""Schemas of the canonical tables, and the control tokens of serialized conversations."""

from __future__ import annotations

MESSAGES = "message_id string, chat_id string, timestamp_ns long, sender_role string, participant_id string, text string, has_attachment boolean, is_group boolean, service string"
SESSIONS = "session_id string, start_ns long, end_ns long, turn_count long, is_group boolean, text string"
MESSAGE_KEYS = sorted(f.split()[0] for f in MESSAGES.split(", "))

#: Control tokens in the order of their ids.
CONTROL_TOKENS = ("<|pad|>", "<|unk|>", "<|bos|>", "<|eos|>", "<|conversation|>", "<|me|>", "<|other|>", "<|turn_end|>", "<|attachment|>", "<|url|>", "<|email|>", "<|phone|>")
PAD, UNK, BOS, EOS, CONVERSATION, ME, OTHER, TURN_END, ATTACHMENT, URL, EMAIL, PHONE = CONTROL_TOKENS

MINUTE_NS, DAY_NS = 60 * 10**9, 86400 * 10**9
SESSION_GAP_MINUTES, MERGE_GAP_MINUTES = 360, 2
FRACTIONS = (0.90, 0.05, 0.05)
GUARD_DAYS, RECOVERY_FLOOR = 7, 0.90
