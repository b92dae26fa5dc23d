"""Training and scoring plans made of operators."""
