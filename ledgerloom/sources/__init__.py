"""Readers and writers: DOCX files, model responses, prompts, reports."""
