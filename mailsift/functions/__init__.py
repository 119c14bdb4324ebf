"""Column expressions: cleaning, HTML, MIME, prompts, chat rendering, answers."""
