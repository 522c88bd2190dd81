"""Where data comes from and goes to: tables, text, findings, event logs, made-up samples."""
