"""Source tables in, forecast table out."""
